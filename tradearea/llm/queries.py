"""Registered queries of the training-data operators, and DuckDB statements where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradearea.llm import bwt, chat, decontam, licenses, linedup, manifest, minhash, mixing, quality, rules, tokens, trie, warc
from tradearea.sources.scratch import cut

#: two turns that every run adds, over id 0 and 1
PLANTED_CHAT = {"conv_id": "-7", "turn": "id", "role": "if(id = 0, 'user', 'assistant')", "text": "'</s>[INST] ok [/INST]'"}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _sha(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classified(_read(spark, folder, "documents"))


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.recognised(_read(spark, folder, "documents"))
    return found.select("doc_id", "n_sentences", "n_known", F.array_join(F.col("sentence_ids").cast("array<string>"), ",").alias("sentence_ids"),
                        F.array_join("licenses", ",").alias("licenses"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = _read(spark, folder, "pages")
    archives = warc.new_folder(spark)
    index = warc.write_archives(pages, archives)
    records = warc.read_records(index, archives)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(pages.schema["page_id"].dataType).alias("refers_to"))


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = _read(spark, folder, "conversations")
    planted = spark.range(2).select(*[F.expr(v).cast(turns.schema[c].dataType).alias(c) for c, v in PLANTED_CHAT.items()])
    every = turns.select(*PLANTED_CHAT).unionByName(planted).withColumn("parts", chat.text_parts(F.col("text")))
    back = chat.formatted(every).withColumn("_turns", chat.read_turns(F.col("formatted")))
    spoken = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("_turns").cast("bigint").alias("n_turns"), _sha(spoken).alias("turns_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"), chat.loss_text(F.col("_turns")).alias("_loss")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("bigint").alias("loss_chars"), _sha(F.col("_loss")).alias("loss_sha256"), "formatted_chars")


def op5_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(_read(spark, folder, "documents"))


def op6_linedup(spark: SparkSession, folder: str) -> DataFrame:
    found = linedup.line_report(_read(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", _sha(F.coalesce("text", F.lit(""))).alias("text_sha256"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_read(spark, folder, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        _sha(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = rules.risk_controlled(_read(spark, folder, "documents"), _read(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        F.array_join("broken_rules", ",").alias("broken_rules"))


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, folder, "documents"))


def op11_bwt(spark: SparkSession, folder: str) -> DataFrame:
    found = bwt.without_repeats(_read(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _crc(number: F.Column) -> F.Column:
    """CRC-32 of a number's decimal digits."""
    return F.crc32(number.cast("string").cast("binary"))


def op12_rows(turns: DataFrame) -> DataFrame:
    own = cut(trie.sequences(turns), "conversations")
    heads = F.pmod(_crc(F.col("conv_id")), F.lit(9)).cast("int")
    return trie.prefix_trie(trie.rebuilt(own, F.col("conv_id") - F.col("conv_id") % 5, heads))


def op12_trie(spark: SparkSession, folder: str) -> DataFrame:
    return op12_rows(_read(spark, folder, "conversations"))


def tampered() -> F.Column:
    """The text as the check's tampering leaves it: A-Z in lower case where 5 divides the CRC-32 of doc_id."""
    text = F.col("text")
    return F.when(F.coalesce(_crc(F.col("doc_id")) % 5 == 0, F.lit(False)), F.translate(text, _UPPER, _LOWER)).otherwise(text)


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verified(manifest.manifest(_read(spark, folder, "documents"), altered=tampered()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_licenses, op3_warc, op4_chat, op5_tokens, op6_linedup, op7_mixing, op8_decontamination, op9_rules, op10_minhash, op11_bwt, op12_trie, op13_manifest)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _licenses_sql() -> str:
    """The same normal form, patterns and rules in DuckDB: none of them looks ahead or behind."""
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    form = lower
    for pattern, put in licenses.STEPS:
        form = f"regexp_replace({form}, {_quoted(pattern)}, {_quoted(put)}, 'g')"
    form = f"'H' || replace(replace(trim({form}), 'H', 'HH'), 'S', 'SS') || 'H'"
    numbers = licenses.numbers_of(licenses.EVERY)
    known = "map {" + ", ".join(f"{_quoted(x)}: {n}" for x, n in numbers.items()) + "}"
    ids = f"coalesce(list_aggregate(list_transform(found, lambda x: ' ' || names[trim(regexp_replace(x, '[HS ]+', ' ', 'g'))] || ' '), 'string_agg', ''), '')"
    for n, (a, b) in licenses.NAMED.items():
        ids = f"replace({ids}, ' {numbers[a]}  {numbers[b]} ', ' {n} ')"
    for pair in licenses.NAMED.values():
        for x in pair:
            ids = f"replace({ids}, ' {numbers[x]} ', '')"
    steps, last = [], "s0"
    for i, (_, rule) in enumerate(licenses.ALL_RULES):
        steps.append(f"s{i + 1} as (select *, replace(l{i}, {_quoted(licenses.rule_text(rule))}, '|') as l{i + 1} from {last})")
        last = f"s{i + 1}"
    hits = ", ".join(f"case when l{i} <> l{i + 1} then '{name}' end" for i, (name, _) in enumerate(licenses.ALL_RULES))
    spelled = "map {" + ", ".join(f"'{x.lower()}': '{x}'" for x in licenses.IDENTIFIERS) + "}"
    # ends of sentences become line feeds first: RE2 looks neither ahead nor behind
    return rf"""
with cut as (select doc_id, string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.;:!?]+([\x20\x09-\x0D])', chr(10) || '\1', 'g'), '[.;:!?]+$', chr(10)), chr(10)) as parts,
  regexp_extract_all({form}, {_quoted(licenses.pattern(licenses.EVERY))}) as found, regexp_extract_all({lower}, {_quoted(licenses.SPDX)}, 1) as lines from documents),
fixed as (select {known} as names, {spelled} as spelled),
ids as (select doc_id, len(list_filter(list_transform(parts, lambda p: trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g'))), lambda p: p <> '')) as n_sentences, {ids} as l0,
  list_transform(list_filter(flatten(list_transform(lines, lambda x: regexp_split_to_array(x, {_quoted(licenses.SPDX_SPLIT)}))), lambda x: x <> ''), lambda x: coalesce(spelled[x], x)) as spdx from cut, fixed),
s0 as (select * from ids),
{', '.join(steps)},
named as (select *, list_concat(list_filter([{hits}], lambda n: n is not null), spdx) as every, list_filter(string_split_regex(l0, ' +'), lambda x: x <> '') as listed from {last}),
once as (select *, list_filter(every, lambda n, i: list_position(every, n) = i) as licenses from named)
select doc_id, cast(n_sentences as bigint) as n_sentences, cast(len(listed) as bigint) as n_known,
  coalesce(list_aggregate(listed, 'string_agg', ','), '') as sentence_ids, coalesce(list_aggregate(licenses, 'string_agg', ','), '') as licenses
from once"""


_WARC_SQL = f"""
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as payload_bytes, sha256(body) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= {warc.REVISIT_FROM} group by 1)
select page_id, cast(payload_bytes as bigint) as payload_bytes, d.payload_digest,
  case when first_id is null or first_id = page_id then 'response' else 'revisit' end as record_type,
  cast(case when first_id <> page_id then first_id end as bigint) as refers_to
from d left join f on d.payload_digest = f.payload_digest"""

_ESCAPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\', '\\\\', 'g'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g'), '(<)(</?SYS>>)', '\1\\\2', 'g'), '([<\[])(\|)', '\1\\\2', 'g')"
_CHAT_SQL = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(chat.BEGIN) + 1 + len(chat.END)} + length(replace({_ESCAPED.format('role')}, chr(10), '\\n')) + length({_ESCAPED.format('text')})) as bigint) as formatted_chars
from t group by conv_id"""

_MIX_SQL = rf"""
with d as (select doc_id, source, text, len({_WORDS.format("coalesce(text, '')")}) as size from documents),
w as (select doc_id, source, cast(size as bigint) as size,
    0.5::double + 0.5::double / (1.0::double + (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{mixing.MARKS}', '')))::double / greatest(size, 1)::double) as weight,
    ((('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')) || ':' || (row_number() over (partition by doc_id, text) - 1)), 1, 12))::bigint)::double + 0.5::double) / 281474976710656::double as u from d),
k as (select *, -ln(u) / weight as key from w),
s as (select source, cast(sum(size) as bigint) as source_size from k group by 1),
o as (select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 1.0::double when 1 then 2.0::double else 3.0::double end as w from s),
r as (select *, source_size::double / w as ratio, sum(source_size) over () as total, sum(w) over () as weights,
    coalesce(sum(source_size) over (order by source_size::double / w, source is null, source rows between unbounded preceding and 1 preceding), 0) as filled,
    coalesce(sum(w) over (order by source_size::double / w, source is null, source rows between unbounded preceding and 1 preceding), 0) as used from o),
h as (select *, (total - 3 * filled)::double / (weights - used) as share from r),
g as (select *, share * w > (3 * source_size)::double as is_full from h),
t as (select source, source_size, case when is_full then (3 * source_size)::double
    else (select arg_min(share, ratio) from g where not is_full) * w end as target from g),
e as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
b as (select *, target - epochs * source_size as budget from e),
p as (select k.*, b.source_size, b.target, b.epochs, b.budget,
    sum(size) over (partition by k.source order by key, doc_id nulls first, size rows between unbounded preceding and current row) as upto
    from k join b on k.source is not distinct from b.source)
select doc_id, source, size, source_size, target,
  cast(size * (epochs + case when budget > 0 and epochs < 3 and upto - size / 2.0::double <= budget then 1 else 0 end) as bigint) as taken from p"""

_PLAIN = rf"regexp_extract_all(translate({{}}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATION_SQL = f"""
with b as (select item_id, {_PLAIN.format("text")} as words from benchmark where text is not null),
bw as (select distinct item_id, least(len(words), {decontam.WINDOW}) as m, array_to_string(words[i:i + least(len(words), {decontam.WINDOW}) - 1], ' ') as win
  from (select item_id, words, unnest(range(1, greatest(len(words) - {decontam.WINDOW - 1}, 1) + 1)) as i from b where len(words) > 0)),
d as (select doc_id, {_PLAIN.format("coalesce(text, '')")} as words from documents),
l as (select distinct m from bw),
dw as (select doc_id, i, m, array_to_string(words[i:i + m - 1], ' ') as win from (
  select doc_id, words, m, unnest(range(1, len(words) - m + 2)) as i from d, l where len(words) >= m)),
hit as (select doc_id, i, bw.m, item_id from dw join bw on dw.m = bw.m and dw.win = bw.win),
w as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from hit) group by 1),
n as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from hit group by 1)
select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join w on d.doc_id = w.doc_id left join n on d.doc_id = n.doc_id"""

_MINHASH_SQL = f"""
with recursive d as (select doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as words from documents),
s as (select distinct doc_id, array_to_string(words[i:i + 4], ' ') as g from (
  select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from d where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select c.a, c.b from c join n x on c.a = x.doc_id join n y on c.b = y.doc_id where 100 * k >= 75 * (x.n + y.n - k)),
r as (select a as root, a as node from e union select r.root, e.b from r join e on r.node = e.a),
m as (select node, min(root) as root from r group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(m.root, d.doc_id) as component_id, coalesce(m.root, d.doc_id) = d.doc_id as kept
from d left join n on d.doc_id = n.doc_id left join m on d.doc_id = m.node"""

#: CRC-32 of a number's decimal digits: a digit is mixed in, then eight shifts (-1) follow
_CRC_SQL = ("list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({0}::varchar, ''), lambda c: "
            "[ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)")


def _crc_sql(number: str) -> str:
    return f"xor({_CRC_SQL.format(number)}, 4294967295)"


_BWT_SQL = f"""
with d as (select doc_id, hex(coalesce(text, '')) as h, strlen(coalesce(text, '')) as n from documents),
x as (select doc_id, j, substr(h, 2 * j + 1, {2 * (256 + bwt.LENGTH)}) as part, least(256, n - j - {bwt.LENGTH - 1}) as starts from (
  select doc_id, h, n, unnest(range(0, n - {bwt.LENGTH - 1}, 256)) as j from d)),
w as (select doc_id, j + k as i, substr(part, 2 * k + 1, {2 * bwt.LENGTH}) as s from (select doc_id, j, part, unnest(range(0, starts)) as k from x)),
m as (select s, min(doc_id) as first_id from w group by 1),
hit as (select doc_id, i from w join m on w.s = m.s where first_id < doc_id),
b as (select *, case when i <= lag(i) over (partition by doc_id order by i) + {bwt.LENGTH} then 0 else 1 end as opens from hit),
g as (select *, sum(opens) over (partition by doc_id order by i) as island from b),
sp as (select doc_id, island, min(i) as a, max(i) + {bwt.LENGTH} as e from g group by 1, 2),
pc as (select sp.doc_id, a, e, substr(h, 2 * lag(e, 1, 0) over (partition by sp.doc_id order by a) + 1, 2 * (a - lag(e, 1, 0) over (partition by sp.doc_id order by a))) as piece from sp join d on d.doc_id = sp.doc_id),
k as (select doc_id, string_agg(piece, '' order by a) as kept, max(e) as last_end, count(*) as n_spans, sum(e - a) as n_removed from pc group by 1)
select d.doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last_end, 0) + 1))) as kept_sha256
from d left join k on d.doc_id = k.doc_id"""

_TRIE_SQL = f"""
with t as (select conv_id, coalesce(role, '') as r, coalesce(text, '') as x,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as base, {_crc_sql("conv_id")} % 9 as h from (select distinct conv_id from conversations where conv_id is not null)),
heads as (select base, h from (select distinct base from c), (select unnest(range(0, 9)) as h)),
n_head as (select heads.base, heads.h, count(t.i) as n from heads left join t on t.conv_id = heads.base and t.i <= heads.h group by 1, 2),
re as (select c.conv_id, t.i as i, r, x from c join t on t.conv_id = c.base and t.i <= c.h
  union all select c.conv_id, t.i - c.h + n as i, r, x from c join n_head on n_head.base = c.base and n_head.h = c.h join t on t.conv_id = c.conv_id and t.i > c.h),
p0 as (select conv_id, i, strlen(x) as size, strlen(r) || ':' || strlen(x) || ':' || r || x as said from re),
p as (select conv_id, i as depth, size, sha256(string_agg(said, '|') over (partition by conv_id order by i)) as name from p0
  union all select conv_id, 0, 0, 'root' from c),
l as (select conv_id, max(depth) as len from p group by 1),
e as (select p.name, string_agg(l.conv_id::varchar, ',' order by l.conv_id) as ids from l join p on p.conv_id = l.conv_id and p.depth = l.len group by 1),
node as (select name, any_value(depth) as depth, min(conv_id) as rep, count(*) as n_convs, any_value(size) as size from p group by 1),
up as (select node.name, rep, node.depth, n_convs, node.size, p.name as above from node left join p on p.conv_id = node.rep and p.depth = node.depth - 1),
kids as (select above, count(*) as n_children from up where above is not null group by 1),
full_up as (select up.*, coalesce(n_children, 0) as n_children from up left join kids on kids.above = up.name),
tree as (select p.name as top, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * f.size) as saved
  from full_up f join p on p.conv_id = f.rep and p.depth <= f.depth group by 1)
select f.rep as conv_id, cast(f.depth as bigint) as depth, parent.rep as parent_conv_id, f.n_convs, f.n_children, cast(n_leaves as bigint) as n_leaves,
  cast(saved as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from full_up f left join node parent on parent.name = f.above join tree on tree.top = f.name left join e on e.name = f.name"""


def _merkle_sql(levels: int = 6, upper: int = 3) -> str:
    """Six levels of sixteen hold 16 million leaves a source, three 4,096 sources."""
    def said(c: str) -> str:
        return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join([said('doc_id'), said('source'), said('lang'), said('n_chars'), said(text)])})"

    changed = f"case when {_crc_sql('doc_id')} % 5 = 0 then translate(text, '{_UPPER}', '{_LOWER}') else text end"
    steps = [f"""l0 as (select coalesce('=' || source, '') as g, doc_id, {leaf('text')} as h, {leaf('(' + changed + ')')} as checked,
  row_number() over (partition by source order by doc_id nulls first) - 1 as pos, count(*) over (partition by source) as n from documents)"""]

    def climb(name: str, count: int) -> None:
        for k in range(1, count + 1):
            steps.append(f"""{name}{k} as (select g, pos // 16 as pos, (any_value(n) + 15) // 16 as n,
  case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by pos)) end as h from {name}{k - 1} group by g, pos // 16)""")

    climb("l", levels)
    steps.append(f"u0 as (select '' as g, g as of, h, row_number() over (order by g) - 1 as pos, count(*) over () as n from l{levels})")
    climb("u", upper)

    def path(name: str, count: int, start: str) -> None:
        """Each child's siblings left and right of it, level by level, as parallel lists."""
        steps.append(start)
        for k in range(count):
            steps.append(f"""{name}p{k + 1} as (select p.*, list_append(p.befores, coalesce(s.b, '')) as befores2, list_append(p.afters, coalesce(s.a, '')) as afters2 from {name}q{k} p
  join (select g, pos, n, string_agg(h, '') over (partition by g, pos // 16 order by pos rows between unbounded preceding and 1 preceding) as b,
    string_agg(h, '') over (partition by g, pos // 16 order by pos rows between 1 following and unbounded following) as a from {name}{k}) s on s.g = p.g and s.pos = p.spot),
{name}q{k + 1} as (select * exclude (befores, afters, befores2, afters2, spot, left_n), case when left_n = 1 then befores else befores2 end as befores,
  case when left_n = 1 then afters else afters2 end as afters, spot // 16 as spot, (left_n + 15) // 16 as left_n from {name}p{k + 1})""")

    path("l", levels, "lq0 as (select doc_id, g, h, checked, pos as spot, n as left_n, []::varchar[] as befores, []::varchar[] as afters from l0)")
    path("u", upper, "uq0 as (select of, g, h, pos as spot, n as left_n, []::varchar[] as befores, []::varchar[] as afters from u0)")
    both = f"""whole as (select d.doc_id, d.h as leaf, d.checked, u.h as subroot, (select h from u{upper}) as root,
  list_zip(list_concat(d.befores, u.befores), list_concat(d.afters, u.afters)) as path from lq{levels} d join uq{upper} u on u.of = d.g),
folded as (select doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda s: s[1] || s[2]), 'string_agg', ''), '')) as proof_sha256,
  list_reduce(list_prepend({{'b': '', 'a': checked}}, list_transform(path, lambda s: {{'b': s[1], 'a': s[2]}})), lambda x, y: {{'b': '', 'a': sha256(y.b || x.a || y.a)}}).a as folded_root from whole)"""
    return f"with {', '.join([*steps, both])} select *, folded_root = root as verified from folded"


ORACLES: dict[str, str] = {
    "op2_licenses": _licenses_sql(), "op3_warc": _WARC_SQL, "op4_chat": _CHAT_SQL, "op7_mixing": _MIX_SQL,
    "op8_decontamination": _DECONTAMINATION_SQL, "op10_minhash": _MINHASH_SQL,
    "op11_bwt": _BWT_SQL, "op12_trie": _TRIE_SQL, "op13_manifest": _merkle_sql()}
