"""Queries of the training-data problems over their whole tables, and SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions.keys import norm_id, spelling
from veldspar.llm import defects, leakage, mixing, packing, pii, splitting, syntax
from veldspar.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.verdicts(table(spark, d, "files")).where("not valid").select("repo", "relpath")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(syntax.verdicts(table(spark, d, "files")))


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    """Capacity per profile; the profiles are a fixed handful."""
    rows = table(spark, d, "review_profiles").select(spelling("profile").alias("p"), "capacity_tokens").where("p is not null and capacity_tokens >= 1").groupBy("p").agg(F.max("capacity_tokens").alias("c")).collect()
    return {r.p: r.c for r in rows}


def _file_chars(spark: SparkSession, d: str) -> DataFrame:
    lens = splitting.current_files(table(spark, d, "files"))
    return lens.select("repo", "relpath", (F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x + 1)).alias("chars"))


def _dossiers(spark: SparkSession, d: str) -> DataFrame:
    """A review's dossier; one that was not counted goes by the size of its file."""
    reviews = table(spark, d, "file_reviews").select("review_id", "repo", F.col("file_path").alias("relpath"), spelling("profile").alias("box"), "dossier_tokens").distinct()
    counted = F.col("dossier_tokens") > 0
    estimate = F.greatest(F.lit(1).cast("long"), F.floor(F.col("chars") / 4))
    open_ = reviews.where(~F.coalesce(counted, F.lit(False))).join(_file_chars(spark, d), ["repo", "relpath"], "left")
    return reviews.where(counted).select("box", F.col("review_id").cast("string").alias("key"), F.col("dossier_tokens").cast("long").alias("length")).unionByName(
        open_.select("box", F.col("review_id").cast("string").alias("key"), F.coalesce(estimate, F.lit(1).cast("long")).alias("length"))
    )


def _definitions(spark: SparkSession, d: str) -> DataFrame:
    """Each definition once per profile that lists it, a token for four characters of its lines, one for an unknown."""
    listed = table(spark, d, "chunks").select(spelling("profile").alias("box"), F.explode("node_ids").alias("id")).select("box", norm_id("id").alias("key")).distinct()
    nodes = table(spark, d, "nodes").select(norm_id("id").alias("key"), F.struct("last_indexed", "ord").alias("v"), F.struct("repo", F.regexp_replace(F.regexp_replace("file", r"\\", "/"), r"^(\./|/)+", "").alias("relpath"), "start_line", "end_line").alias("n")).groupBy("key").agg(F.max_by("n", "v").alias("n"))
    placed = listed.join(nodes, "key", "left").select("box", "key", "n.*")
    lens = splitting.current_files(table(spark, d, "files"))
    own = F.slice("lens", F.greatest(F.col("start_line"), F.lit(1)), F.greatest(F.col("end_line") - F.greatest(F.col("start_line"), F.lit(1)) + 1, F.lit(0)))
    chars = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x + 1)
    return placed.join(lens, ["repo", "relpath"], "left").select("box", "key", F.greatest(F.lit(1).cast("long"), F.coalesce(F.floor(chars / 4), F.lit(1).cast("long"))).alias("length"))


def p4_dossier_calls(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(_dossiers(spark, d), _capacities(spark, d))


def p4_dossier_fill(spark: SparkSession, d: str) -> DataFrame:
    caps = _capacities(spark, d)
    return packing.fills(packing.packed(_dossiers(spark, d), caps), caps)


def p4_definition_calls(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(_definitions(spark, d), _capacities(spark, d))


def p4_definition_fill(spark: SparkSession, d: str) -> DataFrame:
    caps = _capacities(spark, d)
    return packing.fills(packing.packed(_definitions(spark, d), caps), caps)


def p4_dossier_totals(spark: SparkSession, d: str) -> DataFrame:
    """What must come out of the packing whatever the calls are: every item and token once, no call too full."""
    caps = _capacities(spark, d)
    parts = packing.packed(_dossiers(spark, d), caps)
    full = packing.fills(parts, caps).groupBy("box").agg(F.count_if(F.col("used") > F.col("capacity")).alias("n_too_full"))
    return parts.groupBy("box").agg(F.count_distinct("key").alias("n_items"), F.sum("length").alias("n_tokens")).join(full, "box")


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return defects.best_records(table(spark, d, "findings"), table(spark, d, "source_trust"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.representatives(table(spark, d, "findings"), table(spark, d, "source_trust")).where("is_best").select("first_ord", "best_ord")


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d)


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.chunk_pieces(table(spark, d, "chunks"), table(spark, d, "files"), table(spark, d, "nodes"), table(spark, d, "review_profiles"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(_pieces(spark, d))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of the cut chunks, with its text."""
    return splitting.piece_texts(_pieces(spark, d), table(spark, d, "files"))


def p7_joined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each cut chunk put together again without their overlaps, as a hash."""
    t = p7_pieces(spark, d)
    lines = F.split("text", "\n", -1)
    skip = (F.col("new_from") - F.col("first_line")).cast("int")
    new = F.when(F.col("start_char").isNotNull(), F.col("text")).otherwise(F.array_join(F.slice(lines, skip + 1, F.size(lines) - skip), "\n"))
    link = F.when((F.col("piece") == 0) | (F.col("start_char") > 0), "").otherwise("\n")
    whole = t.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("piece", F.concat(link, new).alias("t")))).alias("p"))
    return whole.select("chunk_id", F.md5(F.array_join(F.transform("p", lambda x: x["t"]), "").cast("binary")).alias("hash"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.places(pii.redacted(table(spark, d, "documents"))).select("doc_id", "start_pos", "kind")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents")).select("doc_id", "text", F.size("places").alias("n_places"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_rates, p4_dossier_calls, p4_dossier_fill, p4_dossier_totals, p4_definition_calls, p4_definition_fill, p5_found, p5_survivors, p7_found, p7_pieces, p7_joined, p8_found, p8_items, p9_mix, p9_shares, p10_found, p10_redacted)
}

_WS = "' ' || chr(9) || chr(10) || chr(13)"
_NOTHING = "('', '-', '--', 'n/a', 'na', 'none', 'null', 'nil', 'nan', 'unknown', 'tbd', '?', '.', '...', 'not available', 'undefined')"


def _spelling(c: str) -> str:
    return f"nullif(regexp_replace(lower(trim({c}, {_WS})), '[\\s_\\-./]+', '_', 'g'), '')"


def _holds(c: str) -> str:
    return f"coalesce(lower(trim({c}, {_WS})) not in {_NOTHING}, false)"


_SPANS = f"""
with f as (select repo, relpath, max_by(text, last_indexed) x from (select repo, relpath, last_indexed, text from files where text is not null) group by 1, 2),
fl as (select repo, relpath, case when x = '' then [] when x[-1] = chr(10) then string_split(x, chr(10))[:-2] else string_split(x, chr(10)) end l from f),
n as (select lower(trim(id)) id, max_by(start_line, last_indexed) s, max_by(end_line, last_indexed) e from nodes group by 1),
c as (select distinct chunk_id, repo, file_path, profile, start_line, end_line from chunks),
sp as (select chunk_id, min(s) s, max(e) e from (select distinct chunk_id, lower(trim(unnest(node_ids))) id from chunks) join n using (id) group by 1),
z as (select c.chunk_id, c.repo, file_path, piece_limit_chars m, case when coalesce(start_line, 0) > 0 and coalesce(end_line, 0) > 0 then start_line else s end a, case when coalesce(start_line, 0) > 0 and coalesce(end_line, 0) > 0 then end_line else e end b
  from c left join sp using (chunk_id) join review_profiles using (profile))
"""

ORACLES = {
    "p5_found": f"""
with trust as (select {_spelling('source')} s, max(trust) t from source_trust group by 1),
rec as (select distinct ord, repo, trim(owning_fqn, {_WS}) o, {_spelling('subcategory')} k, line, reported_at,
  ({_holds('message')})::int + (severity is not null and not isnan(severity))::int + ({_holds('confidence')})::int + ({_holds('source')})::int c,
  case when {_holds('source')} then coalesce(trust.t, 0) else 0 end t
  from findings left join trust on trust.s = {_spelling('findings.source')} where line is not null and repo is not null),
mark as (select *, case when line - lag(line) over w <= 3 then 0 else 1 end new from rec window w as (partition by repo, o, k order by line, ord)),
grp as (select *, sum(new) over (partition by repo, o, k order by line, ord rows unbounded preceding) g from mark),
top as (select repo, o, k, g, min(ord) first_ord, count(*) n, max(c) c, max(reported_at) r, max(t) t from grp group by all)
select first_ord, min(ord) as best_ord from top join grp using (repo, o, k, g) where n > 1 and grp.c = top.c and grp.reported_at = top.r and grp.t = top.t group by repo, o, k, g, first_ord""",
    "p7_found": _SPANS + """select chunk_id from z join fl on fl.repo = z.repo and fl.relpath = z.file_path where length(array_to_string(l[a:b], chr(10))) > m""",
    "p8_found": """
with dw as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null),
iw as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from eval_items where text is not null),
ir as (select distinct item_id, array_to_string(w[i:i + 11], ' ') r from (select item_id, w, unnest(range(1, len(w) - 10)) i from iw)),
dr as (select doc_id, array_to_string(w[i:i + 11], ' ') r from (select doc_id, w, unnest(range(1, len(w) - 10)) i from dw))
select distinct doc_id, item_id from dr join ir using (r)""",
}
ORACLES["p8_items"] = f"select item_id, suite, coalesce(n, 0) as n_documents from (select item_id, max(suite) suite from eval_items group by 1) left join (select item_id, count(*) n from ({ORACLES['p8_found']}) group by 1) using (item_id)"

ORACLES["p7_joined"] = _SPANS + "select chunk_id, md5(array_to_string(l[a:b], chr(10))) as hash from z join fl on fl.repo = z.repo and fl.relpath = z.file_path where length(array_to_string(l[a:b], chr(10))) > m"
ORACLES["p4_dossier_totals"] = f"""
with f as (select repo, relpath, arg_max({{'x': text}}, last_indexed).x x from files group by 1, 2), r as (select distinct review_id, repo, file_path, {_spelling('profile')} box, dossier_tokens from file_reviews),
l as (select distinct box, review_id, case when dossier_tokens > 0 then dossier_tokens else greatest(1, coalesce((length(x) + case when x = '' or ends_with(x, chr(10)) then 0 else 1 end) // 4, 1)) end n from r left join f on f.repo = r.repo and f.relpath = r.file_path)
select l.box, count(distinct review_id) as n_items, sum(n) as n_tokens, 0 as n_too_full from l join (select distinct {_spelling('profile')} box from review_profiles where capacity_tokens >= 1) p using (box) group by 1"""
