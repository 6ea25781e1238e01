"""The numbered operators as queries over their whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_automaton,
    conversation_trie,
    exact_dedup,
    html_text,
    licenses,
    merkle_manifest,
    near_dedup,
    packing,
    suffix_dedup,
    token_planes,
    topk_search,
    toxicity,
    url_rules,
)
from ..session import materialize
from .ship import new_folder, ship

Query = Callable[[SparkSession, str], DataFrame]

#: Files of the public tokenizers; their folder is a parameter of the installation.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` computes the same rows on the same tables."""

    def register(fn: Query) -> Query:
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def public_tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_exact_dedup",
    r"""
    with d as (
      select doc_id, coalesce(text, '') as t,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare
      from documents
    ), k as (
      select *, first_value(doc_id) over w as keep_id, count(*) over (partition by bare) as group_size
      from d window w as (partition by bare order by length(t) desc, doc_id
                          rows between unbounded preceding and unbounded following)
    )
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(bare) as text_sha256 from k
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    groups = exact_dedup.exact_groups(
        table(spark, sf_dir, "documents"),
        carry={"text_sha256": F.sha2(exact_dedup.squeezed(text), 256)},
    )
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_components(table(spark, sf_dir, "documents"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: Rules of the query: (host, path, verdict).
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query(
    "op2_url_rules",
    r"""
    with a as (
      select page_id,
             case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
      from pages
    ), b as (
      select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from a
    ), c as (
      select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path
      from b
    ), d as (
      select *, case
        when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
        when (host = 'net' or host like '%.net') and path like '/%' then 'net/'
        when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
        when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
      end as rule from c
    )
    select page_id, host, path, rule,
           case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
    from d
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op3_token_planes")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_planes.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizer(WORD_BPE), end_id=1)
    return token_planes.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(
        table(spark, sf_dir, "documents"), public_tokenizer(WORD_BPE), end_id=1, capacity=4096
    ).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = packing.pack(pieces, 4096, ["doc_id", "ids_crc32", "piece"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op10_bpe_automaton")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe_automaton.encode_documents(docs, public_tokenizer(BYTE_BPE))
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = html_text.extract_pages(pages).select("page_id", "url", "text")
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


@query("op8_licenses")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_documents(docs).select("doc_id", "licenses.*")
    base = F.filter("matches", lambda m: m["base"])

    def labels(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    # Wording that is found in full speaks for a license the more, the longer it is.
    longest = F.array_max(F.transform("matches", lambda m: m["length"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(longest / (longest + 2.0), F.lit(0.0)).alias("score"),
    )


@query("op9_topk_search")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_inner_products(
        table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5
    )


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def _crc32_sql(value: str) -> str:
    """DuckDB expression of the CRC-32 of a value's decimal text, bit by bit."""
    codes = f"list_transform(string_split({value}::varchar, ''), lambda ch: ascii(ch)::bigint)"
    bits = "lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end"
    one = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), {bits})"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), {one}), 4294967295)"


def _merkle_sql(levels: int = 8, arity: int = 8) -> str:
    """The manifest for up to ``arity ** levels`` rows of a language, one level after another."""

    def tree(name: str) -> str:
        ctes, run = [], f"(partition by tree, idx // {arity} order by idx rows between "
        for k in range(levels):
            ctes.append(f"""{name}s{k} as (
              select *, coalesce(string_agg(hash, '') over {run}unbounded preceding and 1 preceding), '') as l,
                     coalesce(string_agg(hash, '') over {run}1 following and unbounded following), '') as r
              from {name}{k} where size > 1)""")
            ctes.append(f"""{name}{k + 1} as (
              select tree, idx // {arity} as idx, (size + {arity - 1}) // {arity} as size, sha256(l || hash || r) as hash
              from {name}s{k} where idx % {arity} = 0)""")
        tops = " union all ".join(f"select tree, hash from {name}{k} where size = 1" for k in range(levels + 1))
        return ",\n".join([*ctes, f"{name}top as ({tops})"])

    def field(value: str) -> str:
        return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"

    steps = [(f"a{k}", f"a.tree = a{k}.tree and a.idx // {arity**k} = a{k}.idx", f"as{k}") for k in range(levels)]
    steps += [(f"b{k}", f"a.tree // {arity**k} = b{k}.idx", f"bs{k}") for k in range(levels)]
    proof = " || ".join(f"coalesce({n}.l || {n}.r, '')" for n, _, _ in steps)
    joins = "\n".join(f"left join {source} {n} on {on}" for n, on, source in steps)
    folds, last = [], "other"
    for i, (n, _, _) in enumerate(steps):
        folds.append(f"f{i} as (select *, case when {n}l is null then {last} else sha256({n}l || {last} || {n}r) end"
                     f" as fold{i} from {f'f{i - 1}' if i else 'p'})")
        last = f"fold{i}"
    kept = ", ".join(f"{n}.l as {n}l, {n}.r as {n}r" for n, _, _ in steps)
    lower = f"translate(text, '{merkle_manifest.UPPER}', '{merkle_manifest.LOWER}')"
    return f"""
    with d as (
      select doc_id, lang, {leaf('text')} as leaf,
             case when {_crc32_sql('doc_id')} % 3 = 0 then {leaf(lower)} else {leaf('text')} end as other
      from documents
    ), g as (
      select lang, count(*) as size, row_number() over (order by lang nulls first) - 1 as tree from d group by lang
    ), a as (
      select d.*, g.tree, g.size, row_number() over (partition by g.tree order by doc_id nulls first, leaf) - 1 as idx
      from d join g on d.lang is not distinct from g.lang
    ), a0 as (select tree, idx, size, leaf as hash from a),
    {tree('a')},
    b0 as (select 0 as tree, tree as idx, (select count(*) from g) as size, hash from atop),
    {tree('b')},
    p as (
      select doc_id, leaf, other, t.hash as subroot, (select hash from btop) as root, sha256({proof}) as proof_sha256,
             {kept}
      from a join atop t on a.tree = t.tree
      {joins}
    ), {", ".join(folds)}
    select doc_id, leaf, subroot, root, proof_sha256, {last} as folded_root, {last} = root as verified from f{len(steps) - 1}
    """


@query("op13_merkle_manifest", _merkle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle_manifest.manifest(
        table(spark, sf_dir, "documents"),
        tampered={"text": merkle_manifest.lower_ascii(F.col("text"))},
        tampered_where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0,
    )
    made = made.withColumns({
        "proof": merkle_manifest.proof_digest(F.col("path")),
        "folded": merkle_manifest.fold(F.col("other_leaf"), F.col("path")),
    })
    names = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof_sha256": "proof", "folded_root": "folded"}
    return made.select(
        "doc_id",
        *[merkle_manifest.hexed(F.col(c)).alias(name) for name, c in names.items()],
        (F.col("folded") == F.col("root")).alias("verified"),
    )


@query(
    "op11_conversation_trie",
    f"""
    with o as (
      select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) - 1 as i,
             coalesce(role, '') as role, coalesce(text, '') as text
      from conversations where conv_id is not null
    ), s as (
      select c, count(*) as size, {_crc32_sql('c')} % 9 as h from o group by c
    ), p as (
      select s.c, s.size, s.h, s.c - s.c % 5 as donor, least(s.h, coalesce(d.size, 0)) as base
      from s left join s d on d.c = s.c - s.c % 5
    ), r as (
      select o.c, p.base + o.i - p.h as pos, role, text from o join p on o.c = p.c where o.i >= p.h
      union all
      select p.c, o.i, role, text from o join p on o.c = p.donor where o.i < p.h
    ), k as (
      select c, pos, strlen(text) as n_bytes, sha256(strlen(role) || ':' || role || text) as t from r
    ), x as (
      select c, pos + 1 as depth, n_bytes,
             sha256(string_agg(t, ',') over (partition by c order by pos)) as node,
             case when pos = 0 then 'root'
                  else sha256(string_agg(t, ',') over (partition by c order by pos
                              rows between unbounded preceding and 1 preceding)) end as parent
      from k
      union all
      select c, 0, 0, 'root', null from p
    ), lengths as (select c, max(depth) as len from x group by c),
    n as (
      select node, depth, any_value(parent) as parent, min(x.c) as conv_id, count(*) as n_convs,
             max(n_bytes) as n_bytes,
             sha256(coalesce(string_agg(x.c::varchar, ',' order by x.c) filter (where len = depth), '')) as ends_sha256
      from x join lengths on x.c = lengths.c group by node, depth
    ), m as (
      select n.*, (select count(*) from n ch where ch.parent = n.node) as n_children from n
    ), sub as (
      select top.node, sum((m.n_convs - 1) * m.n_bytes)::bigint as saved_tokens,
             count(*) filter (where m.n_children = 0) as n_leaves
      from m join x as under on under.node = m.node and under.c = m.conv_id
      join x as top on top.c = under.c and top.depth <= m.depth group by top.node
    )
    select m.conv_id, m.depth::bigint as depth, up.conv_id as parent_conv_id, m.n_convs, m.n_children, sub.n_leaves,
           sub.saved_tokens, m.ends_sha256
    from m join sub on m.node = sub.node left join m up on up.node = m.parent
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = materialize(conversation_trie.numbered_turns(table(spark, sf_dir, "conversations")))
    conv = F.col("conv")
    turns, convs = conversation_trie.rebuilt_turns(
        numbered, donor=conv - conv % 5, given=F.crc32(conv.cast("string")) % 9, most=8
    )
    return conversation_trie.prefix_trie(turns, convs)


@query("op12_suffix_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
