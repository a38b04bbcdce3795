"""The registered queries of this subpackage and their SQL, over the driver tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations,
    decontaminate,
    manifest,
    maxscore,
    near_dedup,
    packing,
    pii,
    ppm,
    quality,
    style_tree,
    substring_dedup,
    suffix_dedup,
    url_filter,
)
from .common import table

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
with words as (
    select 'd' as kind, doc_id as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
    union all
    select 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')
    from benchmark
), widths as (
    select distinct least(5, len(w)) as width from words where kind = 'i' and len(w) > 0
), shingles as (
    select distinct kind, id, array_to_string(w[i:i + width - 1], ' ') as s, width
    from (
        select kind, id, w, width, unnest(range(1, len(w) - width + 2)) as i
        from words join widths on width <= len(w) and (kind = 'd' or width = least(5, len(w)))
    )
), sizes as (
    select id, count(*) as n from shingles where kind = 'i' group by id
)
select d.id as doc_id, i.id as item_id, n as n_shingles, count(*) as n_shared, count(*) / n as containment
from shingles d join shingles i using (s, width) join sizes on i.id = sizes.id
where d.kind = 'd' and i.kind = 'i'
group by d.id, i.id, n
having count(*) * 5 >= n * 4
"""


PII_KEY = b"demonstration key; a deployment passes its own"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def byte_bpe():
    """The public byte-level BPE; its files are read in the tasks that encode."""
    return packing.byte_bpe_encoder(
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), byte_bpe())
    return pieces.select(
        "doc_id",
        "start",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_filter.rules_frame(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 20)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
with words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), each as (
    select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words
), spelled as (
    select doc_id, i, concat_ws(' ', word, LEADS) as s, lead(i, 19) over d as last
    from each window d as (partition by doc_id order by i)
), windows as (
    select doc_id, i, row_number() over (partition by s order by doc_id, i) > 1 as later
    from spelled where last is not null
), gone as (
    select distinct doc_id, unnest(range(i, i + 20)) as i from windows where later
), counted as (
    select each.doc_id, count(gone.i) as n_removed,
           coalesce(string_agg(word, ' ' order by each.i) filter (gone.i is null), '') as kept
    from each left join gone on gone.doc_id = each.doc_id and gone.i = each.i
    group by each.doc_id
)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from words left join counted using (doc_id)
""".replace("LEADS", ", ".join(f"lead(word, {k}) over d" for k in range(1, 20)))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 100)
    return rows.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


OP7_SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), shingles as (
    select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), links as (
    select a.doc_id as a, b.doc_id as b
    from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
         join sizes na on na.doc_id = a.doc_id join sizes nb on nb.doc_id = b.doc_id
    group by a.doc_id, b.doc_id, na.n, nb.n
    having 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach(id, other) as (
    select doc_id, doc_id from documents
    union
    select reach.id, links.b from reach join links on links.a = reach.other
)
select d.doc_id, coalesce(n, 0) as n_shingles, min(other) as component_id, d.doc_id = min(other) as kept
from documents d left join sizes using (doc_id) join reach on reach.id = d.doc_id
group by d.doc_id, n
"""


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search_table(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
with vectors as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
    from embeddings
    where embedding is not null
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id,
           cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
    from vectors q join vectors c on q.vec_id <> c.vec_id
    where q.vec_id % 100 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 10
"""


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ppm.score(table(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 7 <> 2")
    return rows.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(part != 2))
    return quality.score(docs, model).select(
        "doc_id",
        F.coalesce(part == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


OP4_SQL = r"""
with parts as (
    select page_id,
           case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest
    from pages
), split as (
    select page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from parts
), rules(rhost, rpath, verdict) as (
    values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits as (
    select page_id, max_by(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) as best
    from split join rules
      on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
    group by page_id
)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict
from split left join fits using (page_id)
"""

def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with texts as (
    select row_number() over () as row, coalesce(lang, 'und') as lang,
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
    from documents
), pieces as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
    from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from texts)
), phrases as (
    select lang, m as size, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f
    from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from pieces, range(1, 5) lengths(m))
    group by all
), totals as (
    select lang, sum(f) as n from phrases where size = 1 group by lang
), known as (
    select *, string_split(phrase, ' ') as w from phrases where f >= 30
), cuts as (
    select c.lang, c.phrase, c.f as a, k, x.f as l, y.f as r, (2000000::hugeint * c.f) // (x.f + y.f) as score
    from (select *, unnest(range(1, size)) as k from known where size > 1) c
    join known x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ')
    join known y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:], ' ')
), worst as (
    select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_phrases as (
    select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(f) as within
    from (select lang, w, f, m, unnest(range(1, size - m + 2)) as i from known, range(2, 4) lengths(m) where m < size)
    group by all
), ranked as (
    select worst.*, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank
    from worst left join inner_phrases using (lang, phrase)
    where within is null or 100::hugeint * within < 80 * a
)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join totals using (lang) where rank <= 2000
"""


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.main_text(table(spark, sf_dir, "pages"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def _merkle_sql(levels: int, crown: int) -> str:
    """Trees of up to 8 ** levels rows a lang and 8 ** crown langs, one CTE per level."""

    def tree(name: str, first: str, n: int) -> list[str]:
        parts = [first]
        for k in range(n):
            parts.append(
                f"""{name}{k} as (
    select *, count(*) over (partition by grp) > 1 as many,
           coalesce(string_agg(h, '') over (run order by rank rows between unbounded preceding and 1 preceding), '') as l,
           coalesce(string_agg(h, '') over (run order by rank rows between 1 following and unbounded following), '') as r
    from {name}_nodes{k} window run as (partition by grp, rank // 8)
), {name}_nodes{k + 1} as (
    select grp, rank // 8 as rank, case when any_value(many) then sha256(string_agg(h, '' order by rank)) else any_value(h) end as h
    from {name}{k} group by grp, rank // 8
)"""
            )
        return parts

    def frame(f: str) -> str:
        return f"coalesce(strlen(cast({f} as varchar)) || ':' || cast({f} as varchar), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(frame(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(4294967295, list_reduce(
        list_prepend(4294967295::bigint, list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::bigint)),
        lambda c, b: list_reduce(
            list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""
    parts = [
        f"""docs as (
    select coalesce('l' || lang, '') as grp, doc_id, cast(doc_id as varchar) as s, {leaf("text")} as leaf, {leaf(lower)} as changed
    from documents
), placed as (
    select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as place, {crc} % 3 = 0 as tampered
    from docs
)""",
        *tree("g", "g_nodes0 as (select grp, place as rank, leaf as h from placed)", levels),
        *tree("c", f"c_nodes0 as (select '' as grp, row_number() over (order by grp) - 1 as rank, h, grp as of from g_nodes{levels})", crown),
    ]
    fold, proof, joins = "case when tampered then changed else leaf end", [], []
    steps = [(f"g{k}", f"g{k}.grp = placed.grp and g{k}.rank = place // {8**k}") for k in range(levels)]
    steps += [(f"c{k}", f"c{k}.rank = o.rank // {8**k}") for k in range(crown)]
    folds = []
    for i, (t, on) in enumerate(steps):
        joins.append(f"join {t} on {on}")
        proof.append(f"{t}.l || {t}.r")
        folds.append(f"{t}.many as m{i}, {t}.l as l{i}, {t}.r as r{i}")
    parts.append(
        f"""chains as (
    select doc_id, leaf, o.h as subroot, {fold} as f0, sha256({" || ".join(proof)}) as proof_sha256, {", ".join(folds)}
    from placed join c_nodes0 o on o.of = placed.grp {" ".join(joins)}
)"""
    )
    for i in range(len(steps)):
        hashed = f"case when m{i} then sha256(l{i} || f{i} || r{i}) else f{i} end"
        parts.append(f"folded{i} as (select *, {hashed} as f{i + 1} from {f'folded{i - 1}' if i else 'chains'})")
    last = len(steps) - 1
    return (
        "with " + ", ".join(parts) + f""" select doc_id, leaf, subroot, t.h as root, proof_sha256, f{last + 1} as folded_root,
        f{last + 1} = t.h as verified from folded{last}, c_nodes{crown} t"""
    )


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_url_filter": op4_url_filter,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_maxscore": op8_maxscore,
    "op9_ppm": op9_ppm,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_html": op12_html,
    "op13_manifest": op13_manifest,
}
ORACLES = {
    "op1_decontamination": OP1_SQL,
    "op4_url_filter": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op7_near_dedup": OP7_SQL,
    "op8_maxscore": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op13_manifest": _merkle_sql(levels=7, crown=3),
}
