"""One registered query for every operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import byte_pairs, exact_dedup, fingerprints, lm_scoring, merkle, near_duplicates, packing, prefix_trie, quality_classifier, quality_rules, sharding, shared, simple8b, suffix_dedup
from tessella.llm.registry import documents, query


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    "op2_quality_rules",
    rf"""
    with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
    p as (select k, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
    v as (select k, i, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o as win
          from p window o as (partition by k order by i)),
    r as (select k, i from (select k, i, count(*) over (partition by k, win) as c from v where win is not null) where c > 1),
    m as (select k, count(distinct i + j)::bigint as n from r, unnest(range(0, 5)) as t(j) group by k),
    l as (select k, unnest(string_split(text, chr(10))) as line from d),
    u as (select k, (sum(c) - count(*))::bigint as n_dup, sum(c)::bigint as n_lines
          from (select k, line, count(*) as c from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by k, line) group by k),
    s as (select k, count(*)::bigint as n from p where regexp_matches(word, '[#*$%&|<>]') group by k),
    x as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
          len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(u.n_dup, 0) as n_dup_lines, coalesce(m.n, 0) as n_repeat_words,
          coalesce(u.n_lines, 0) as n_lines, len(regexp_extract_all(text, '[A-Z]')) as n_upper, coalesce(s.n, 0) as n_marked_words
          from d left join m using (k) left join u using (k) left join s using (k)),
    f as (select *, (case when n_words < 10 then 1 else 0 end + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end
          + case when 100 * n_marked_words > 30 * n_words then 4 else 0 end + case when 100 * n_symbols > 10 * word_chars then 8 else 0 end
          + case when n_dup_lines >= 4 and 100 * n_dup_lines > 50 * n_lines then 16 else 0 end + case when 100 * n_upper > 45 * word_chars then 32 else 0 end
          + case when word_chars > 25 * n_words then 64 else 0 end + case when word_chars < 2 * n_words then 128 else 0 end
          + case when 100 * n_repeat_words > 85 * n_words then 256 else 0 end + case when n_words < 1 then 512 else 0 end)::bigint as failed from x)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed, failed & 255 = 0 as kept, failed from f""",
)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality_rules.ledger(documents(spark, sf))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"),
        quality_rules.passes().alias("kept"),
        "failed",
    )


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf), vocabulary("word_bpe_49k.json"))


@query("op4_packing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf), vocabulary("word_bpe_49k.json"))
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset", "tier", "step_group")


@query("op6_simple8b")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    path = shared.folder(spark, "ids")
    simple8b.write(documents(spark, sf), path, vocabulary("byte_bpe_50k.json"))
    return simple8b.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op8_byte_pairs")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    rows = byte_pairs.encode(documents(spark, sf), path, decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


SHARD_WEIGHTS = {f"shard-{k:03d}": 2 if k % 16 == 0 else 1 for k in range(sharding.SHARDS)}
_FEWER = dict(list(SHARD_WEIGHTS.items())[:-1])


def _owners(weights: dict[str, int]) -> str:
    return f"select unnest({sharding.fill(weights)}) as shard, unnest(range({sharding.SLOTS})) as slot"


@query(
    "op3_sharding",
    f"""
    with a as ({_owners(SHARD_WEIGHTS)}), b as ({_owners(_FEWER)}),
    d as (select doc_id, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {sharding.SLOTS}) as slot from documents)
    select doc_id, a.shard::int as shard, b.shard::int as shard_with_one_fewer from d join a using (slot) join b using (slot)""",
)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.place(documents(spark, sf).select("doc_id"), "doc_id", SHARD_WEIGHTS)
    return sharding.place(placed, "doc_id", _FEWER, name="shard_with_one_fewer")


@query("op5_fingerprints")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    rows = fingerprints.with_next(documents(spark, sf))
    rows = rows.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
    rows = fingerprints.with_sketch(rows, "edited", "edited_sketch")
    near = fingerprints.resemblance
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        near(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        near(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


@query("op7_near_duplicates")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf), size=2, percent=80)


def quality_model(spark: SparkSession, sf: str, docs: DataFrame) -> quality_classifier.Model:
    """The classifier fitted on labelled rows outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return quality_classifier.fit(docs, labels.filter(~quality_classifier.held_out(5)))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    rows = quality_classifier.scored(docs, quality_model(spark, sf, docs), F.col("doc_id"))
    rows = rows.withColumnRenamed("key", "doc_id")
    predicted = (F.col("score") >= quality_classifier.THRESHOLD).cast("int")
    return rows.select("doc_id", quality_classifier.held_out(5).alias("held_out"), "score", predicted.alias("predicted"), "n_passages")


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    rows = suffix_dedup.removed(documents(spark, sf).select("doc_id", "text"))
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return rows.select(
        F.col("rest.doc_id").alias("doc_id"), "n_bytes", cut.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op13_exact_dedup",
    r"""
    with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
    g as (select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id, count(*) over (partition by text_sha256) as group_size from d)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g""",
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf))


_CRC = [0, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]


def crc32_sql(number: str) -> str:
    """DuckDB SQL for the CRC-32 of a decimal number, four bits at a time."""
    codes = f"list_transform(string_split({number}::varchar, ''), lambda c: ascii(c))"
    halves = f"flatten(list_transform({codes}, lambda b: [(b & 15)::bigint, (b >> 4)::bigint]))"
    table = "[" + ", ".join(f"{v}::bigint" for v in _CRC) + "]"
    return f"xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, {halves}), lambda c, x: xor(c >> 4, {table}[(xor(c, x) & 15) + 1])))"


def _merkle_sql(levels: int = 24, top_levels: int = 6) -> str:
    """Tables ``t0, t1, ...`` of a group's nodes level by level, then ``u0, u1, ...`` of the subroots' tree."""
    enc = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda n: f"sha256({enc('doc_id')} || {enc('source')} || {enc('lang')} || {enc(n)} || {enc('text')})"
    steps = [
        f"""leaves as materialized (select doc_id, lang, {leaf('n_chars')} as h, case when {crc32_sql('doc_id')} % 7 = 0 then {leaf('(n_chars + 1)')} else {leaf('n_chars')} end as v,
        row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as n from documents)""",
        "t0 as materialized (select lang, i, h, n from leaves)",
        "p0 as materialized (select doc_id, lang, i, h as leaf, v, '' as proof, n from leaves)",
    ]

    def up(nodes: str, paths: str, k: int, by: str) -> None:
        # A level of a group that is down to one node hands it on as it is.
        steps.append(
            f"""{nodes}{k} as materialized (select {by}, i // 2 as i, case when n = 1 then min(h) else sha256(string_agg(h, '' order by i)) end as h, (n + 1) // 2 as n
            from {nodes}{k - 1} group by {by}, i // 2, n)"""
        )
        steps.append(
            f"""{paths}{k} as materialized (select p.* exclude (i, v, proof, n), p.i // 2 as i, (p.n + 1) // 2 as n, p.proof || coalesce(s.h, '') as proof,
            case when p.n = 1 then p.v when s.h is null then sha256(p.v) when p.i % 2 = 0 then sha256(p.v || s.h) else sha256(s.h || p.v) end as v
            from {paths}{k - 1} p left join {nodes}{k - 1} s on p.{by} is not distinct from s.{by} and s.i = xor(p.i, 1))"""
        )

    for k in range(1, levels + 1):
        up("t", "p", k, "lang")
    steps.append(f"u0 as materialized (select 0 as one, lang, h, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from t{levels})")
    steps.append(f"q0 as materialized (select 0 as one, p.* exclude (i, n), u.h as subroot, u.i, u.n from p{levels} p join u0 u on p.lang is not distinct from u.lang)")
    for k in range(1, top_levels + 1):
        up("u", "q", k, "one")
    return f"""with {', '.join(steps)} select doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, v as folded_root, v = r.h as verified
    from q{top_levels} cross join (select h from u{top_levels}) r"""


@query("op11_merkle_manifest", _merkle_sql())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in columns]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf(*tampered))
    rows = documents(spark, sf).select("doc_id", F.col("lang").alias("grp"), merkle.leaf(*(F.col(c) for c in columns)).alias("leaf"), changed.alias("changed"))
    found = merkle.manifest(rows)
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation c as the first h turns of c - c % 5, then its own after its first h; and all conversations."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = convs.select("conv_id", "length", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("source"))
    sources = convs.select(F.col("conv_id").alias("source"), F.col("length").alias("source_length"))
    convs = shared.written(convs.join(sources, "source", "left").withColumn("taken", F.least("h", F.coalesce("source_length", F.lit(0)))), "conversations")
    rest = ["a", "b", "bytes"]
    own = turns.join(convs, "conv_id").filter("pos >= h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), *rest)
    heads = turns.filter("pos < 8").withColumnRenamed("conv_id", "source").join(convs, "source").filter("pos < h")  # h is at most 8
    return own.unionByName(heads.select("conv_id", (F.col("pos") + 1).alias("depth"), *rest)), convs.select("conv_id")


@query(
    "op12_prefix_trie",
    f"""
    with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) - 1 as i
      from conversations where conv_id is not null),
    k as (select c, count(*) as len, {crc32_sql('c')} % 9 as h, c - c % 5 as b from t group by c),
    m as (select k.c, k.h, k.b, least(k.h, coalesce(s.len, 0)) as m from k left join k s on s.c = k.b),
    r as (select m.c, t.i + 1 as d, role, text from m join t on t.c = m.b where t.i < m.h
      union all select m.c, m.m + t.i - m.h + 1, role, text from m join t on t.c = m.c where t.i >= m.h),
    x as (select c, d, strlen(text) as bytes,
      sha256(string_agg(strlen(role) || ':' || role || ':' || strlen(text) || ':' || text, '') over (partition by c order by d)) as key from r),
    p as (select c, 0 as d, 0 as bytes, '' as key from k union all select c, d, bytes, key from x),
    q as materialized (select *, lag(key) over (partition by c order by d) as up, d = max(d) over (partition by c) as ends from p),
    n as materialized (select d, key, any_value(up) as up, min(c) as c, count(*) as n_convs, max(bytes) as bytes,
      sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ends), '')) as ends_sha256 from q group by d, key),
    f as (select d - 1 as d, up as key, count(*) as n from n where d > 0 group by d, up),
    v as materialized (select n.*, coalesce(f.n, 0) as n_children from n left join f using (d, key)),
    s as (select q.d, q.key, count(*) filter (where v.n_children = 0) as n_leaves, sum((v.n_convs - 1) * v.bytes)::bigint as saved_tokens
      from v join q on q.c = v.c and q.d <= v.d group by q.d, q.key)
    select v.c as conv_id, v.d::bigint as depth, u.c as parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
    from v join s using (d, key) left join n u on u.d = v.d - 1 and u.key = v.up""",
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    turns = prefix_trie.turns(spark.read.parquet(f"{sf}/conversations.parquet"))
    found = prefix_trie.trie(*rebuilt(turns))
    ends = F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return found.nodes.join(prefix_trie.id_digests(found.ends), "id", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends
    )
