"""The queries op1 to op13 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import ann, bpe, chat, decontaminate, lm, manifest, negatives, packing, quality, sharding, simhash, suffix_dedup, token_store
from folioscope.llm.common import new_path, table, utf8_bytes

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    return public_tokenizers.path(BYTE_BPE)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    said, tree = chat.format_conversations(table(spark, sf_dir, "conversations").select(extra.columns).unionByName(extra))
    return chat.read_back(said, tree)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, capacity=2048)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_tokens")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (utf8_bytes("text") + 16).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.assign_shards(docs, 40, "doc_id", "size", ties=("text_crc32",))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    read = token_store.read_store(spark, path).select("doc_id", "part", "block", "nth", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return read.join(token_store.starts(spark, path), ["part", "block", "nth"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path()), tokenizer_path())
    return both.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.mine(rows, F.col("id") % 100 == 0)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampering = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest.manifest(table(spark, sf_dir, "documents"), columns, "doc_id", "source", {"text": manifest.lower_az(F.col("text"))}, tampering)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat, op2_simhash, op3_quality, op4_packing, op5_ann, op6_lm, op7_suffix_dedup, op8_sharding, op9_token_store, op10_bpe, op11_negatives, op12_manifest, op13_decontaminate)}


def _escaped_chars(column: str) -> str:
    """The length of a text after escaping: one more for each of five characters."""
    return f"(length({column}) * 6 - " + " - ".join(f"length(replace({column}, '{c}', ''))" for c in ("\\", "[", "]", "<", ">")) + ")"


OP1_SQL = f"""
with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(chars) as bigint) as formatted_chars, cast(sum(chars) - arg_max(chars, nth) as bigint) as leaf_start
from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as nth,
    {_escaped_chars('text')} + case role when 'user' then 18 when 'system' then 13 when 'assistant' then 5 else 15 + {_escaped_chars('role')} end as chars from said) group by conv_id
"""


OP3_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents), w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
windows as (select doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as g from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from w)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from windows) where n > 1),
repeats as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by 1),
lines as (select doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as own from (select doc_id, unnest(string_split(text, chr(10))) as line from d)),
told as (select doc_id, line, own, len(own) as n, list_sum(list_transform(own, lambda x: length(x))) as chars,
    len(list_filter(own, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > 0.3 * len(own)
    or len(list_filter(own, lambda x: x in ('|', '>', '»', '•', '·'))) >= 3
    or len(own) <= 24 and regexp_matches(line, '(?i)BOILERPLATE')
    or len(own) >= 4 and (upper(line) = line and lower(line) <> line or length(regexp_replace(line, '[^A-Z]', '', 'g')) > 0.6 * strlen(line))
    or len(own) > 12 and not regexp_matches(line, '[.!?…。！？](?:\s|$|["''”’»)\]])|[:;"''”’»)\]]\s*$') as fails from lines where len(own) > 0),
by_line as (select doc_id, count(*) - count(distinct line) as dup, coalesce(sum(chars) filter (fails), 0) as lost, coalesce(sum(n) filter (not fails), 0) as left_words from told group by 1),
base as (select w.doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    coalesce(dup, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(lost, 0) as lost, coalesce(left_words, 0) as left_words from w left join by_line using (doc_id) left join repeats r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost <= 0.5 * word_chars and left_words >= 50 as kept from base
""".replace("BOILERPLATE", quality.BOILERPLATE)


OP11_SQL = """
with e as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
met as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
    from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
),
positives as (select anchor_id, vec_id as positive_id, score from met where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by m.score desc, m.vec_id) as integer) as rank,
    m.vec_id as negative_id, p.score as positive_score, m.score as negative_score
from positives p join met m on m.anchor_id = p.anchor_id and not m.same and 30 * p.score <= 100 * m.score and 100 * m.score <= 90 * p.score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by m.score desc, m.vec_id) <= 10
"""


#: crc32 of decimal ids, bit by bit.
_CRC = "list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda c, b: list_reduce(list_prepend(xor(c, b), cast([0, 0, 0, 0, 0, 0, 0, 0] as bigint[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
_CHECKED = f"checked as (select *, xor({_CRC}, 4294967295) as crc from documents)"


def _merkle_sql(levels: int = 5) -> str:
    """The manifest level by level, each group of 16 nodes at a time; enough for 16 ** levels leaves a source and as many sources."""
    value = lambda c: f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(value, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = []

    def climb(name: str, group: str, n: int) -> None:
        for i in range(n):  # every node of a run has the hashes of the whole run, then its siblings are what is not itself
            steps.append(f"""{name}_run{i} as (select {group}, p // 16 as run, list(h order by p) as hs, count(*) as n from {name}{i} group by all)""")
            steps.append(f"""{name}_sum{i} as (select *, count(*) over (partition by {group}) > 1 or n > 1 as grows from {name}_run{i})""")
            steps.append(f"""{name}{i + 1} as (select {group}, run as p, case when grows then sha256(array_to_string(hs, '')) else hs[1] end as h from {name}_sum{i})""")

    steps.append(f"""d as (select doc_id, source, {leaf('text')} as leaf, case when crc % 5 = 0 then {leaf(lower)} else {leaf('text')} end as altered from checked)""")
    steps.append("leaves as (select *, row_number() over (partition by source order by doc_id) - 1 as p from d)")
    steps.append("a0 as (select source, p, leaf as h from leaves)")
    climb("a", "source", levels)
    steps.append(f"subs as (select source, h as subroot, row_number() over (order by source nulls first) - 1 as sp from a{levels})")
    steps.append("b0 as (select 0 as one, sp as p, subroot as h from subs)")
    climb("b", "one", levels)
    before, proof = "l", []
    steps.append("f0 as (select l.doc_id, l.source, l.p, s.sp, s.subroot, l.leaf, l.altered as h, '' as proof from leaves l join subs s on l.source is not distinct from s.source)")
    at = 0
    for name, place, on in (("a", "p", "f.source is not distinct from r.source and"), ("b", "sp", "")):
        for i in range(levels):
            left, right = f"array_to_string(hs[:f.{place} % 16], '')", f"array_to_string(hs[f.{place} % 16 + 2:], '')"
            steps.append(f"""f{at + 1} as (select doc_id, f.source, {'p // 16 as p, sp' if place == 'p' else 'p, sp // 16 as sp'}, subroot, leaf,
                case when grows then sha256({left} || h || {right}) else h end as h, case when grows then proof || {left} || {right} else proof end as proof
                from f{at} f join {name}_sum{i} r on {on} r.run = f.{place} // 16)""")
            at += 1
    return "with " + ",\n".join([_CHECKED, *steps]) + f"""
    select doc_id, leaf, subroot, b.h as root, sha256(proof) as proof_sha256, f.h as folded_root, f.h = b.h as verified from f{at} f, b{levels} b"""


_OWN_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
with b as (select item_id, {_OWN_WORDS} as w from benchmark where text is not null), d as (select row_number() over () as r, doc_id, coalesce({_OWN_WORDS}, []) as w from documents),
strings as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + 9], ' ') as s from (select *, unnest(generate_series(1, greatest(1, len(w) - 9))) as i from b where len(w) > 0)),
sizes as (select distinct n from strings), ats as (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, sizes where len(w) >= n),
met as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as s from ats semi join strings on strings.n = ats.n and strings.s = array_to_string(w[i:i + ats.n - 1], ' ')),
hits as (select r, count(distinct x) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as x from met) group by r),
items as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from met join strings using (n, s) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (r) left join items using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op3_quality": OP3_SQL, "op11_negatives": OP11_SQL, "op12_manifest": _merkle_sql(), "op13_decontaminate": OP13_SQL}
