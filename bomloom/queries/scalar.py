"""Queries of scalar functions, matching, licences and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomloom import testdata
from bomloom.functions import licence as lic
from bomloom.functions import purl as pu
from bomloom.functions import text as tx
from bomloom.functions import version as ve
from bomloom.model import Tables
from bomloom.operators import differ, enrichment, matching, rules
from bomloom.queries.fleetwide import PAIRS, M
from bomloom.runtime import materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- functions: every two part names, and the freely written names of the inventory -----------
_NAMES = "names AS (SELECT DISTINCT p_name AS n FROM part), pairs AS (SELECT x.n AS a, y.n AS b FROM names x JOIN names y ON x.n < y.n)"


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    return names.join(names.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))


_TOKENS = "list_distinct(list_filter(regexp_split_to_array({0}, '[-_.@/]'), lambda t: t <> ''))"
_GRAMS = "CASE WHEN length({0}) < 3 THEN [{0}] ELSE list_distinct([substr({0}, i, 3) FOR i IN range(1, length({0}) - 1)]) END"


def _jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / greatest(len({a}) + len({b}) - len(list_intersect({a}, {b})), 1) END"


@query(f"WITH {_NAMES}, t AS (SELECT *, {_TOKENS.format(chr(39) + '-' + chr(39) + ' || replace(a, chr(32), chr(45))')} AS ta, {_TOKENS.format('replace(b, chr(32), chr(45))')} AS tb, {_GRAMS.format('a')} AS ga, {_GRAMS.format('b')} AS gb FROM pairs) SELECT a, b, round({_jaccard_sql('ta', 'tb')}, 9) AS token_sim, round({_jaccard_sql('ga', 'gb')}, 9) AS trigram_sim FROM t")
def fn_token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _name_pairs(spark, sf_dir)
    dash = lambda c: F.replace(c, F.lit(" "), F.lit("-"))
    return p.select("a", "b", F.round(tx.token_similarity(dash("a"), dash("b")), 9).alias("token_sim"), F.round(tx.trigram_similarity(F.col("a"), F.col("b")), 9).alias("trigram_sim"))


@query(f"WITH {_NAMES} SELECT a, b, round(1 - levenshtein(a, b) / greatest(strlen(a), strlen(b)), 9) AS lev_sim, round(jaro_winkler_similarity(a, b), 6) AS jw_sim FROM pairs")
def fn_edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _name_pairs(spark, sf_dir)
    return p.select("a", "b", F.round(tx.levenshtein_similarity(F.col("a"), F.col("b")), 9).alias("lev_sim"), F.round(tx.jaro_winkler(F.col("a"), F.col("b")), 6).alias("jw_sim"))


_L, _C = "regexp_replace(upper(n), '[^A-Z]', '', 'g')", "translate({0}, 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455600000000')"


@query(
    f"WITH names AS (SELECT DISTINCT name AS n FROM inventory UNION SELECT DISTINCT p_name FROM part), l AS (SELECT n, {_L} AS l FROM names), c AS (SELECT n, l, {_C.format('l[1:1]')} AS f, list_filter(string_split({_C.format('l')}, ''), lambda x: x <> '0' AND x <> '') AS ds FROM l), "
    "q AS (SELECT n, l, f, array_to_string(list_filter(ds, lambda x, i: i = 1 OR ds[i - 1] <> x), '') AS s FROM c) SELECT n AS name, CASE WHEN l = '' THEN '' ELSE left(l[1:1] || rpad(CASE WHEN f = '0' THEN s ELSE s[2:] END, 3, '0'), 4) END AS code FROM q"
)
def fn_soundex(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "inventory").select("name").union(table(spark, sf_dir, "part").select("p_name")).distinct()
    return names.select("name", tx.soundex(F.col("name")).alias("code"))


@query("SELECT comp_id, CASE WHEN regexp_extract(purl, '^pkg:([^/]+)', 1) <> '' THEN regexp_extract(purl, '^pkg:([^/]+)', 1) END AS kind, CASE WHEN regexp_extract(purl, '^pkg:[^/]+/(?:.*/)?([^/@?#]*)[^/]*$', 1) <> '' THEN regexp_extract(purl, '^pkg:[^/]+/(?:.*/)?([^/@?#]*)[^/]*$', 1) END AS name, CASE WHEN contains(purl, '@') THEN regexp_extract(purl, '@([^?#]*)', 1) END AS version, regexp_replace(lower(purl), '@[^@]*$', '') AS base, CASE lower(CASE WHEN regexp_extract(purl, '^pkg:([^/]+)', 1) <> '' THEN regexp_extract(purl, '^pkg:([^/]+)', 1) END) WHEN 'pypi' THEN regexp_replace(lower(purl), '[_.]', '-', 'g') WHEN 'npm' THEN replace(lower(purl), '%40', '@') WHEN 'cargo' THEN replace(lower(purl), '-', '_') WHEN 'maven' THEN purl WHEN 'golang' THEN purl ELSE lower(purl) END AS normal FROM cdx_components")
def fn_purl(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("purl")
    return table(spark, sf_dir, "cdx_components").select("comp_id", pu.purl_type(p).alias("kind"), pu.purl_name(p).alias("name"), pu.purl_version(p).alias("version"), pu.purl_base(p).alias("base"), pu.purl_normal(p).alias("normal"))


_SV = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"


@query(f"WITH v AS (SELECT DISTINCT version AS v FROM cdx_components WHERE version IS NOT NULL), s AS (SELECT v, regexp_matches(v, '{_SV}') AS ok FROM v) SELECT v AS version, CASE WHEN ok THEN CAST(regexp_extract(v, '{_SV}', 1) AS BIGINT) END AS major, CASE WHEN ok THEN CAST(regexp_extract(v, '{_SV}', 2) AS BIGINT) END AS minor, CASE WHEN ok THEN CAST(regexp_extract(v, '{_SV}', 3) AS BIGINT) END AS patch, CASE WHEN ok THEN regexp_extract(v, '{_SV}', 4) END AS pre FROM s")
def fn_semver(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "cdx_components").where("version is not null").select("version").distinct()
    return v.withColumn("s", ve.semver(F.col("version"))).select("version", "s.major", "s.minor", "s.patch", "s.pre")


_DIV_SQL = """CASE WHEN a IS NULL AND b IS NULL THEN 0.5 WHEN a IS NULL OR b IS NULL THEN 0.0 WHEN a = b THEN 1.0
  WHEN pa[1] = pb[1] AND pa[2] = pb[2] THEN greatest(0.8 - 0.01 * abs(pa[3] - pb[3]), 0.5) WHEN pa[1] = pb[1] THEN greatest(0.5 - 0.02 * abs(pa[2] - pb[2]), 0.2) ELSE greatest(0.3 - 0.1 * abs(pa[1] - pb[1]), 0.0) END"""
_BOOST_SQL = "CASE WHEN a = b THEN 0.10 WHEN pa[1] = pb[1] AND pa[2] = pb[2] THEN 0.07 WHEN pa[1] = pb[1] THEN 0.04 ELSE 0.0 END"


@query(f"{M}{PAIRS}, p AS (SELECT old_sbom, new_sbom, x.id, x.version AS a, y.version AS b, [CAST(z AS INT) FOR z IN string_split(x.version, '.')] AS pa, [CAST(z AS INT) FOR z IN string_split(y.version, '.')] AS pb FROM pairs JOIN components x ON x.sbom_id = old_sbom JOIN components y ON y.sbom_id = new_sbom AND x.id = y.id) SELECT old_sbom, new_sbom, id, round(CAST({_DIV_SQL} AS DOUBLE), 9) AS divergence, round(CAST({_BOOST_SQL} AS DOUBLE), 9) AS boost FROM p")
def fn_version_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = testdata.components(spark, sf_dir).select("sbom_id", "id", "version")
    pairs = differ.consecutive_pairs(Tables(c, c, c))
    p = c.withColumnsRenamed({"sbom_id": "old_sbom", "version": "a"}).join(pairs, "old_sbom").join(c.withColumnsRenamed({"sbom_id": "new_sbom", "version": "b"}), ["new_sbom", "id"])
    return p.select(*_DOCS, "id", F.round(ve.version_divergence(F.col("a"), F.col("b")), 9).alias("divergence"), F.round(ve.version_boost(F.col("a"), F.col("b")), 9).alias("boost"))


@query(f"WITH {_NAMES}, d AS (SELECT *, list_max([CASE WHEN left(a, i) = left(b, i) THEN i ELSE 0 END FOR i IN range(0, least(length(a), length(b)) + 1)]) AS prefix FROM pairs) SELECT a, b, CAST(prefix AS INTEGER) AS prefix, CAST(list_max([CASE WHEN right(a, i) = right(b, i) THEN i ELSE 0 END FOR i IN range(0, least(length(a), length(b)) - prefix + 1)]) AS INTEGER) AS suffix FROM d")
def ui_inline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).withColumn("d", tx.inline_difference(F.col("a"), F.col("b"))).select("a", "b", "d.prefix", "d.suffix")


# --- licences -------------------------------------------------------------------
_SAMPLES = ["MIT", "LGPL-2.1-only", "LGPL-3.0", "AGPL-3.0", "GPL-2.0-only", "CC0-1.0", "proprietary", "BSD-4-Clause", "WTFPL", "Mozilla Public", "EPL-2.0", "CDDL-1.0", "Zlib", "Unlicense", "Apache-2.0 OR GPL-2.0", "private use"]


def _info_sql(x: str) -> dict[str, str]:
    """The classification written out as nested searches, apart from the operator's table."""
    has = lambda *words: f"regexp_matches(lower({x}), '{'|'.join(words)}')"
    free, gpl = f"NOT {has('mit', 'apache', 'bsd', 'isc', 'unlicense', 'cc0', 'wtfpl', 'zlib')}", has("gpl")
    weak = has("mpl", "mozilla", "eclipse", "epl", "cddl")
    closed = has("proprietary", "commercial", "private")
    early = has("mit", "apache", "bsd")
    category = f"CASE WHEN {x} IS NULL THEN 'unknown' WHEN {early} THEN 'permissive' WHEN {has('cc0', 'unlicense')} THEN 'public_domain' WHEN NOT ({free}) THEN 'permissive' WHEN {has('agpl')} THEN 'network_copyleft' WHEN {has('lgpl')} THEN 'weak_copyleft' WHEN {gpl} THEN 'strong_copyleft' WHEN {weak} THEN 'weak_copyleft' WHEN {closed} THEN 'proprietary' ELSE 'unknown' END"
    risk = f"CASE WHEN {x} IS NULL THEN 'medium' WHEN {has('mit', 'apache')} THEN 'low' WHEN {has('bsd')} THEN CASE WHEN {has('4-clause', 'original')} THEN 'medium' ELSE 'low' END WHEN NOT ({free}) THEN 'low' WHEN {has('agpl')} THEN 'critical' WHEN {has('lgpl')} THEN 'medium' WHEN {gpl} THEN 'high' WHEN {weak} THEN 'medium' WHEN {closed} THEN 'critical' ELSE 'medium' END"
    family = f"CASE WHEN {x} IS NULL THEN 'Unknown' WHEN {has('mit')} THEN 'MIT' WHEN {has('apache')} THEN 'Apache' WHEN {has('bsd')} THEN 'BSD' WHEN {has('cc0')} THEN 'Creative Commons' WHEN {has('zlib')} AND NOT {has('unlicense')} THEN 'Zlib' WHEN NOT ({free}) THEN 'Public Domain-like' WHEN {gpl} THEN 'GPL' WHEN {has('mpl', 'mozilla')} THEN 'MPL' WHEN {has('eclipse', 'epl')} THEN 'Eclipse' WHEN {has('cddl')} THEN 'CDDL' WHEN {closed} THEN 'Proprietary' ELSE 'Unknown' END"
    strength = f"CASE WHEN {x} IS NULL OR NOT ({free}) THEN 0 WHEN {has('agpl')} THEN 4 WHEN {has('lgpl')} THEN 1 WHEN {gpl} THEN 3 WHEN {weak} THEN 1 ELSE 0 END"
    patent = f"coalesce(CASE WHEN {has('mit')} THEN false WHEN {has('apache')} THEN true WHEN NOT ({free}) THEN false WHEN {gpl} THEN contains({x}, '3') ELSE {weak} END, false)"
    return {"category": category, "risk": risk, "family": family, "strength": strength, "patent_grant": patent, "network": f"coalesce({free} AND {has('agpl')}, false)"}


_LICENCES_SQL = f"l AS (SELECT DISTINCT license_declared AS x FROM spdx_packages UNION SELECT DISTINCT license_concluded FROM spdx_packages UNION SELECT unnest({_SAMPLES}))"


def _licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "spdx_packages")
    extra = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in _SAMPLES])).alias("x"))
    return p.select(F.col("license_declared").alias("x")).union(p.select("license_concluded")).union(extra).distinct()


@query(f"WITH {_LICENCES_SQL} SELECT x, {', '.join(f'{v} AS {k}' for k, v in _info_sql('x').items() if k != 'strength')} FROM l")
def l_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licences(spark, sf_dir).withColumn("i", lic.licence_info(F.col("x"))).select("x", "i.category", "i.risk", "i.family", "i.patent_grant", "i.network")


@query(f"""WITH {_LICENCES_SQL} SELECT x, coalesce(list_contains({lic.COMMON}, trim(x)) OR regexp_matches(trim(x), ' (AND|OR|WITH) '), false) AS common, coalesce(list_contains({lic.DEPRECATED}, trim(x)), false) AS deprecated,
  coalesce(regexp_matches(upper(trim(x)), '^(A?GPL|LGPL|EUPL|SSPL|OSL|CPAL|CC-BY-SA|CC-BY-NC)'), false) AS restrictive FROM l""")
def l_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _licences(spark, sf_dir).select("x", lic.is_common(x).alias("common"), lic.is_deprecated(x).alias("deprecated"), lic.is_restrictive(x).alias("restrictive"))


@query()
def l_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _licences(spark, sf_dir).select("x", lic.licence_family(x).alias("family"), lic.expression_tree(x).alias("tree")).withColumn("valid", F.col("tree").isNotNull())


_COMPAT_IDS = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "AGPL-3.0-only", "MPL-2.0", "proprietary", "CC0-1.0"]


_I = _info_sql("x")
_PAIR_SCORE = (
    "CAST(CASE WHEN ca <> cb AND (ca = 'proprietary' OR cb = 'proprietary') THEN 0 WHEN (contains(la, 'gpl-2.0-only') AND contains(lb, 'gpl-3')) OR (contains(lb, 'gpl-2.0-only') AND contains(la, 'gpl-3')) THEN 0 "
    "ELSE greatest(100 - CASE WHEN (fa = 'Apache' AND contains(lb, 'gpl-2')) OR (fb = 'Apache' AND contains(la, 'gpl-2')) THEN 30 ELSE 0 END - CASE WHEN ca = 'network_copyleft' OR cb = 'network_copyleft' THEN 20 ELSE 0 END - CASE WHEN ca <> cb AND abs(sa - sb) > 1 THEN 10 * abs(sa - sb) ELSE 0 END, 0) END AS INTEGER)"
)
_PAIRED = "p AS (SELECT a.x AS a, b.x AS b, a.lx AS la, b.lx AS lb, a.cat AS ca, b.cat AS cb, a.st AS sa, b.st AS sb, a.fam AS fa, b.fam AS fb FROM i a JOIN i b ON a.x < b.x)"
_CLASSED = f"i AS (SELECT x, lower(x) AS lx, {_I['category']} AS cat, {_I['strength']} AS st, {_I['family']} AS fam FROM l)"


@query(f"WITH l AS (SELECT unnest({_COMPAT_IDS}) AS x), {_CLASSED}, {_PAIRED} SELECT a, b, {_PAIR_SCORE} AS score FROM p")
def l_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in _COMPAT_IDS])).alias("a"))
    return ids.join(ids.withColumnRenamed("a", "b"), F.col("a") < F.col("b")).select("a", "b", lic.compatibility(F.col("a"), F.col("b")).alias("score"))


@query(f"""{M}, l AS (SELECT DISTINCT licence AS x FROM components WHERE licence IS NOT NULL), {_CLASSED}, {_PAIRED}, s AS (SELECT a, b, {_PAIR_SCORE} AS score FROM p), own AS (SELECT DISTINCT sbom_id, licence FROM components WHERE licence IS NOT NULL),
bad AS (SELECT x.sbom_id, count(*) FILTER (score = 0) AS errors, count(*) FILTER (score > 0 AND score < 70) AS warnings FROM own x JOIN own y ON x.sbom_id = y.sbom_id AND x.licence < y.licence JOIN s ON s.a = x.licence AND s.b = y.licence GROUP BY 1)
SELECT sbom_id, licences, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, CAST(CASE WHEN errors > 0 THEN 0 ELSE greatest(100 - 15 * coalesce(warnings, 0), 0) END AS INTEGER) AS score FROM (SELECT sbom_id, count(*) AS licences FROM own GROUP BY 1) LEFT JOIN bad USING (sbom_id)""")
def l_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lic.compatibility_report(testdata.components(spark, sf_dir).select("sbom_id", "licence"))


# --- matching -------------------------------------------------------------------
_DOCS = ("old_sbom", "new_sbom")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What the identity matches of all consecutive pairs of documents leave, by ``old_sbom, new_sbom``."""
    c = materialize(testdata.components(spark, sf_dir), "components")
    t = Tables(c, c, c)
    pairs = differ.consecutive_pairs(t)
    return tuple(materialize(d, "unmatched") for d in differ.unmatched(t, pairs, differ.identity_matches(t, pairs)))


def _field_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``_sides`` with the columns of the multi-field score only."""
    c = materialize(testdata.components(spark, sf_dir).select("sbom_id", "id", "name", "version", "ecosystem", "licence", "supplier"), "components")
    t = Tables(c, c, c)
    pairs = materialize(differ.consecutive_pairs(t), "pairs")  # written, its size is known: no side is shuffled by document
    return tuple(materialize(d, "unmatched") for d in differ.without_twins(t, pairs))


_NORM_NAME = "CASE WHEN {0}.ecosystem = 'pypi' THEN regexp_replace(lower({0}.name), '[_.]+', '-', 'g') WHEN {0}.ecosystem = 'cargo' THEN replace(lower({0}.name), '-', '_') WHEN {0}.ecosystem = 'npm' THEN lower({0}.name) ELSE regexp_replace(replace(lower({0}.name), '_', '-'), '-+', '-', 'g') END"
_NORM_PURL = "CASE {0}.ecosystem WHEN 'pypi' THEN regexp_replace(lower({0}.purl), '[_.]', '-', 'g') WHEN 'npm' THEN replace(lower({0}.purl), '%40', '@') WHEN 'cargo' THEN replace(lower({0}.purl), '-', '_') WHEN 'maven' THEN {0}.purl WHEN 'golang' THEN {0}.purl ELSE lower({0}.purl) END"
_KEYS_SQL = f"unnest(list_distinct(list_append([left(nn, 1) || g FOR g IN {_GRAMS.format('nn')}], 'p/' || ecosystem || '/' || left(nn, 3)))) AS k"
_BLOCK_SQL = f"""{M}{PAIRS},
old AS (SELECT p.old_sbom, p.new_sbom, c.* FROM pairs p JOIN components c ON c.sbom_id = p.old_sbom WHERE NOT EXISTS (SELECT 1 FROM components d WHERE d.sbom_id = p.new_sbom AND d.id = c.id)),
new AS (SELECT p.old_sbom, p.new_sbom, c.* FROM pairs p JOIN components c ON c.sbom_id = p.new_sbom WHERE NOT EXISTS (SELECT 1 FROM components d WHERE d.sbom_id = p.old_sbom AND d.id = c.id)),
oldn AS (SELECT *, {_NORM_NAME.format('old')} AS nn FROM old), newn AS (SELECT *, {_NORM_NAME.format('new')} AS nn FROM new),
oldk AS (SELECT old_sbom, id, name, {_KEYS_SQL} FROM oldn), newk AS (SELECT old_sbom, new_sbom, id, name, {_KEYS_SQL} FROM newn),
cand AS (SELECT DISTINCT b.old_sbom, b.new_sbom, a.id AS old_id, b.id AS new_id FROM oldk a JOIN newk b ON a.old_sbom = b.old_sbom AND a.k = b.k WHERE abs(length(a.name) - length(b.name)) <= 10)"""
_JOINED = "cand JOIN old o ON o.old_sbom = cand.old_sbom AND o.id = old_id JOIN new n ON n.old_sbom = cand.old_sbom AND n.id = new_id"


@query(f"{_BLOCK_SQL} SELECT * FROM cand")
def er_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.candidates(*_sides(spark, sf_dir), by=_DOCS)


#: Names and their words with Soundex codes, and the pairs of names with their score.
_SCORED_SQL = f"""{_BLOCK_SQL}, named AS (SELECT DISTINCT lower(name) AS nm FROM old UNION SELECT DISTINCT lower(name) FROM new), worded AS (SELECT nm, list_filter(regexp_split_to_array(nm, '[^a-z0-9]+'), lambda t: t <> '') AS ws FROM named),
texts AS (SELECT nm AS n FROM named UNION SELECT unnest(ws) FROM worded), l AS (SELECT n, {_L} AS l FROM texts), c AS (SELECT n, l, {_C.format('l[1:1]')} AS f, list_filter(string_split({_C.format('l')}, ''), lambda x: x <> '0' AND x <> '') AS ds FROM l),
q AS (SELECT n, l, f, array_to_string(list_filter(ds, lambda x, i: i = 1 OR ds[i - 1] <> x), '') AS s FROM c), codes AS (SELECT n, CASE WHEN l = '' THEN '' ELSE left(l[1:1] || rpad(CASE WHEN f = '0' THEN s ELSE s[2:] END, 3, '0'), 4) END AS code FROM q),
sound AS (SELECT w.nm, (SELECT code FROM codes WHERE n = w.nm) AS code, list(codes.code) AS cs FROM (SELECT nm, unnest(ws) AS word FROM worded) w JOIN codes ON codes.n = word GROUP BY w.nm),
np AS (SELECT DISTINCT lower(o.name) AS p, lower(n.name) AS q FROM {_JOINED}),
ph AS (SELECT p, q, CASE WHEN a.code <> '' AND a.code = b.code THEN 1.0 ELSE greatest(len(list_filter(a.cs, lambda x: x <> '' AND list_contains(b.cs, x))), len(list_filter(b.cs, lambda x: x <> '' AND list_contains(a.cs, x)))) / greatest(len(a.cs), len(b.cs)) END AS phon, {_TOKENS.format('p')} AS tp, {_TOKENS.format('q')} AS tq FROM np JOIN sound a ON a.nm = p JOIN sound b ON b.nm = q),
ns AS (SELECT p, q, greatest(0.6 * jaro_winkler_similarity(p, q) + 0.4 * (1 - levenshtein(p, q) / greatest(strlen(p), strlen(q))), {_jaccard_sql('tp', 'tq')}, 0.85 * phon) AS s FROM ph),
full_pairs AS (SELECT cand.*, o.version AS a, n.version AS b, [CAST(z AS INT) FOR z IN string_split(o.version, '.')] AS pa, [CAST(z AS INT) FOR z IN string_split(n.version, '.')] AS pb, ns.s, {_NORM_PURL.format('o')} = {_NORM_PURL.format('n')} AS ex, o.ecosystem = n.ecosystem AND {_NORM_NAME.format('o')} = {_NORM_NAME.format('n')} AS ru FROM {_JOINED} JOIN ns ON p = lower(o.name) AND q = lower(n.name)),
boosted AS (SELECT *, least(s + coalesce({_BOOST_SQL}, 0), 1) AS t FROM full_pairs),
scored AS (SELECT old_sbom, new_sbom, old_id, new_id, CASE WHEN ex THEN 1.0 WHEN ru THEN 0.9 WHEN t >= 0.85 THEN t ELSE 0 END AS score, CASE WHEN ex THEN 'exact' WHEN ru THEN 'ecosystem_rule' WHEN t >= 0.85 THEN 'fuzzy' ELSE 'none' END AS tier FROM boosted)"""


@query(f"{_SCORED_SQL}, w AS (SELECT *, CASE tier WHEN 'exact' THEN 0 WHEN 'ecosystem_rule' THEN 0.03 WHEN 'fuzzy' THEN 0.08 ELSE 0.1 END AS width FROM scored) SELECT old_sbom, new_sbom, old_id, new_id, round(CAST(score AS DOUBLE), 6) AS score, tier, round(CAST(greatest(score - width, 0) AS DOUBLE), 6) AS low, round(CAST(least(score + width, 1) AS DOUBLE), 6) AS high FROM w")
def er_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.explained(matching.all_scores(*_sides(spark, sf_dir), by=_DOCS))
    return out.select(*[F.round(c, 6).alias(c) if c in ("score", "low", "high") else c for c in out.columns])


@query(f"""{_BLOCK_SQL}, al0 AS (SELECT DISTINCT lower(p_name) AS alias, split_part(lower(p_name), ' ', 2) AS canonical FROM part), al AS (SELECT * FROM al0 UNION SELECT canonical, canonical FROM al0),
acand AS (SELECT DISTINCT n.old_sbom, n.new_sbom, o.id AS old_id, n.id AS new_id FROM old o JOIN al x ON lower(o.name) = x.alias JOIN al y ON x.canonical = y.canonical JOIN new n ON n.old_sbom = o.old_sbom AND lower(n.name) = y.alias)
SELECT a.old_sbom, a.new_sbom, a.old_id, a.new_id, CAST(CASE WHEN {_NORM_PURL.format('o')} = {_NORM_PURL.format('n')} THEN 1.0 ELSE 0.95 END AS DOUBLE) AS score FROM acand a JOIN old o ON o.old_sbom = a.old_sbom AND o.id = a.old_id JOIN new n ON n.old_sbom = a.old_sbom AND n.id = a.new_id""")
def er_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose names are aliases of one name: the nouns of the part names."""
    low = F.lower("p_name")
    aliases = table(spark, sf_dir, "part").select(low.alias("alias"), F.split(low, " ")[1].alias("canonical")).distinct()
    return matching.all_scores(*_sides(spark, sf_dir), by=_DOCS, aliases=aliases).where("score >= 0.95 and tier in ('exact', 'alias')").drop("tier")


@query(f"{M}, n AS (SELECT *, {_NORM_NAME.format('components')} AS nn FROM components), k AS (SELECT sbom_id, id, {_KEYS_SQL} FROM n), z AS (SELECT sbom_id, k, count(DISTINCT id) AS n FROM k GROUP BY 1, 2) SELECT sbom_id, count(*) AS blocks, max(n) AS largest, round(avg(n), 6) AS mean FROM z GROUP BY 1")
def er_block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.block_statistics(testdata.components(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(f"{_BLOCK_SQL}, tiers AS (SELECT cand.*, CASE WHEN {_NORM_PURL.format('o')} = {_NORM_PURL.format('n')} THEN 1.0 WHEN o.ecosystem = n.ecosystem AND {_NORM_NAME.format('o')} = {_NORM_NAME.format('n')} THEN 0.9 END AS score FROM {_JOINED}) SELECT old_sbom, new_sbom, old_id, new_id, CAST(score AS DOUBLE) AS score FROM tiers WHERE score IS NOT NULL")
def er_cheap_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.all_scores(*_sides(spark, sf_dir), by=_DOCS).where("tier in ('exact', 'ecosystem_rule')").drop("tier")


@query()
def er_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = tuple(matching.alike(d, _DOCS) for d in _sides(spark, sf_dir))
    return matching.assign(matching.alike_scores(*sides, by=_DOCS), None, _DOCS, sides)


@query()
def er_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = tuple(matching.alike(d, _DOCS) for d in _sides(spark, sf_dir))
    return matching.greedy_assign(matching.alike_scores(*sides, by=_DOCS), _DOCS, sides)


_MULTI_SQL = f"""{_BLOCK_SQL}, p AS (SELECT cand.*, o.version AS a, n.version AS b, [CAST(z AS INT) FOR z IN string_split(o.version, '.')] AS pa, [CAST(z AS INT) FOR z IN string_split(n.version, '.')] AS pb, o.ecosystem AS ea, n.ecosystem AS eb, o.licence AS la, n.licence AS lb, o.supplier AS sa, n.supplier AS sb, 1 - levenshtein(o.name, n.name) / greatest(strlen(o.name), strlen(n.name)) AS ns FROM {_JOINED}),
multi AS (SELECT old_sbom, new_sbom, old_id, new_id, round(greatest(least(0.6 * ns + 0.1 * ({_DIV_SQL}) + CASE WHEN ea <> eb THEN -0.15 ELSE 0.15 END + 0.08 * CASE WHEN la IS NULL AND lb IS NULL THEN 0.5 WHEN la = lb THEN 1 ELSE 0 END + 0.04 * CASE WHEN sa IS NULL AND sb IS NULL THEN 0.5 WHEN sa = sb THEN 1 ELSE 0 END, 1), 0), 6) AS score FROM p)"""


def _score_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.multi_field_counts(*_field_sides(spark, sf_dir), matching.FIELD_WEIGHTS["balanced"], _DOCS)


@query(f"{_MULTI_SQL} SELECT round(quantile_disc(score, 0.9), 6) AS threshold FROM multi")
def er_ratio_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ratio_threshold(_score_counts(spark, sf_dir), 0.1).select(F.round("threshold", 6).alias("threshold"))


@query(f"{_MULTI_SQL} SELECT * FROM multi")
def er_multifield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.multi_field_scores(*_field_sides(spark, sf_dir), matching.FIELD_WEIGHTS["balanced"], _DOCS)


@query(f"{_MULTI_SQL} SELECT count(*) AS n, min(score) AS min_score, max(score) AS max_score, round(avg(score), 9) AS mean_score, round(stddev_pop(score), 9) AS std_score, round(quantile_cont(score, 0.5), 9) AS median_score, count(*) FILTER (score >= 0.9999) AS exact, count(*) FILTER (score <= 0) AS zero FROM multi")
def er_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.score_statistics(_score_counts(spark, sf_dir))
    return out.select(*[F.round(c, 9).alias(c) if c in ("mean_score", "std_score", "median_score") else c for c in out.columns])


@query(
    f"{_MULTI_SQL}, h AS (SELECT CAST(least(floor(score * 100), 99) AS INT) AS bin, count(*) AS n FROM multi GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS below, sum(n * bin) OVER (ORDER BY bin) AS mass, sum(n) OVER () AS total, sum(n * bin) OVER () AS all_mass FROM h), "
    "s AS (SELECT bin, round(CAST(below AS DOUBLE) * (total - below) * pow(mass / below - (all_mass - mass) / (total - below), 2), 6) AS b FROM c WHERE below < total) SELECT round((min(bin) + max(bin)) / 2 / 100 + 0.005, 9) AS threshold FROM s WHERE b = (SELECT max(b) FROM s)"
)
def er_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.otsu_threshold(er_multifield(spark, sf_dir)).select(F.round("threshold", 9).alias("threshold"))


# --- enrichment ------------------------------------------------------------------
AS_OF = "2024-02-01"
_KEV = "kev AS (SELECT DISTINCT 'CVE-2024-' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS cve_id, DATE '2024-01-10' + CAST(user_id % 40 AS INT) AS due_date FROM events WHERE user_id % 10 = 0)"


def _kev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id % 10 = 0").select("user_id").distinct()
    return e.select(F.concat(F.lit("CVE-2024-"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("cve_id"), F.date_add(F.lit("2024-01-10").cast("date"), (F.col("user_id") % 40).cast("int")).alias("due_date"))


_SLA_SQL = "CASE WHEN days IS NULL THEN 'no_due_date' WHEN days < 0 THEN 'overdue' WHEN days <= 3 THEN 'due_soon' ELSE 'on_track' END"


@query(f"{M}, {_KEV}, j AS (SELECT v.*, k.due_date - DATE '{AS_OF}' AS due, k.cve_id IS NOT NULL AS is_kev FROM vulns v LEFT JOIN kev k ON k.cve_id = v.vuln_id), d AS (SELECT *, coalesce(due, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 7 WHEN 'medium' THEN 30 WHEN 'low' THEN 90 END - (DATE '{AS_OF}' - published)) AS days FROM j) SELECT sbom_id, component_id, vuln_id, is_kev, CAST(due AS INTEGER) AS days_until_due, coalesce(due < 0, false) AS overdue, {_SLA_SQL} AS sla FROM d")
def e_kev_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("date")
    v = enrichment.with_kev(testdata.tables(spark, sf_dir).vulns, _kev(spark, sf_dir), as_of)
    return v.select("sbom_id", "component_id", "vuln_id", "is_kev", "days_until_due", "overdue", enrichment.sla_status(F.col("days_until_due"), F.col("severity"), F.col("published"), as_of).alias("sla"))


_CYCLES = "cycles AS (SELECT DISTINCT p_name AS product, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 8 AS VARCHAR) ELSE (p_partkey % 8) || '.' || (p_partkey % 3) END AS cycle, DATE '2023-10-01' + CAST(30 * (p_partkey % 8) + 200 * (p_partkey % 3) AS INT) AS eol, DATE '2023-06-01' + CAST(40 * (p_partkey % 8) AS INT) AS support FROM part WHERE p_partkey % 3 < 2)"


@query(
    f"{M}, {_CYCLES}, t AS (SELECT sbom_id, id, name, 0 AS place, version AS k FROM components UNION ALL SELECT sbom_id, id, name, 1, split_part(version, '.', 1) || '.' || split_part(version, '.', 2) FROM components UNION ALL SELECT sbom_id, id, name, 2, split_part(version, '.', 1) FROM components), "
    "m AS (SELECT sbom_id, id, arg_min({'cycle': cycle, 'eol': eol, 'support': support}, place) AS m FROM t JOIN cycles ON product = name AND cycle = k GROUP BY 1, 2) "
    f"SELECT sbom_id, id, m.cycle AS cycle, CAST(m.eol - DATE '{AS_OF}' AS INTEGER) AS days_until_eol, CASE WHEN m.eol - DATE '{AS_OF}' <= 0 THEN 'end_of_life' WHEN m.eol - DATE '{AS_OF}' <= 180 THEN 'approaching' WHEN m.support <= DATE '{AS_OF}' THEN 'security_only' WHEN m IS NOT NULL THEN 'supported' ELSE 'unknown' END AS status FROM components LEFT JOIN m USING (sbom_id, id)"
)
def e_eol(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").where("p_partkey % 3 < 2")
    cycle = F.when(k % 3 == 0, (k % 8).cast("string")).otherwise(F.concat_ws(".", (k % 8).cast("string"), (k % 3).cast("string")))
    day = lambda d, n: F.date_add(F.lit(d).cast("date"), n.cast("int"))
    cycles = p.select(F.col("p_name").alias("product"), cycle.alias("cycle"), day("2023-10-01", 30 * (k % 8) + 200 * (k % 3)).alias("eol"), day("2023-06-01", 40 * (k % 8)).alias("support")).distinct()
    return enrichment.with_lifecycle(testdata.components(spark, sf_dir), cycles, F.lit(AS_OF).cast("date"))


_NUMBERS = "[CAST(z AS BIGINT) FOR z IN list_filter(string_split(regexp_extract({0}, '[0-9][0-9.]*'), '.'), lambda z: z <> '')]"


@query(f"""WITH v AS (SELECT DISTINCT bom_serial, bom_ref, snap_no, version, loaded_at, row_id FROM cdx_snapshots WHERE version IS NOT NULL), one AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY bom_serial, bom_ref, snap_no ORDER BY loaded_at DESC, row_id DESC) = 1),
c AS (SELECT DISTINCT lag(version) OVER (PARTITION BY bom_serial, bom_ref ORDER BY snap_no) AS was, version AS now FROM one), n AS (SELECT *, {_NUMBERS.format('was')} AS a, {_NUMBERS.format('now')} AS b FROM c WHERE was <> now),
k AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN CASE WHEN b > a THEN 'upgrade' WHEN b < a THEN 'downgrade' ELSE 'none' END WHEN now < was THEN 'downgrade' ELSE 'upgrade' END AS change FROM n)
SELECT was, now, change, CASE WHEN change <> 'downgrade' OR len(a) = 0 OR len(b) = 0 THEN NULL WHEN b[1] < a[1] THEN 'major' WHEN regexp_matches(lower(was), 'security|patch|fix') AND NOT regexp_matches(lower(now), 'security|patch|fix') THEN 'suspicious' ELSE 'minor' END AS severity FROM k""")
def fn_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a component's version between two snapshots that have it."""
    rows = table(spark, sf_dir, "cdx_snapshots").where("version is not null")
    key = ["bom_serial", "bom_ref"]
    one = rows.groupBy(*key, "snap_no").agg(F.max_by("version", F.struct("loaded_at", "row_id")).alias("now"))
    changed = one.select("now", F.lag("now").over(Window.partitionBy(*key).orderBy("snap_no")).alias("was")).where("was <> now").distinct()
    return changed.select("was", "now", ve.direction(F.col("was"), F.col("now")).alias("change"), ve.downgrade_severity(F.col("was"), F.col("now")).alias("severity"))


_VEX = """vex AS (SELECT event_id AS seq, 'CVE-2024-' || lpad(json_extract_string(props, '$.k'), 4, '0') AS vuln_id, ['affected', 'not_affected', 'fixed', 'under_investigation'][CAST(event_id % 4 AS INT) + 1] AS status,
  CASE WHEN event_id % 2 = 0 THEN (SELECT min(purl) FROM components c WHERE c.part_no = event_id % (SELECT count(*) FROM part)) END AS purl FROM events WHERE event_type = 'click' AND event_id % 5 = 0)"""


@query(
    f"{M}, {_VEX}, x AS (SELECT vuln_id, purl, arg_max(status, seq) AS s FROM vex WHERE purl IS NOT NULL GROUP BY 1, 2), w AS (SELECT vuln_id, arg_max(status, seq) AS s FROM vex WHERE purl IS NULL GROUP BY 1), j AS (SELECT v.sbom_id, v.component_id, v.vuln_id, coalesce(x.s, w.s) AS vex_status FROM vulns v JOIN components c ON c.sbom_id = v.sbom_id AND c.id = v.component_id LEFT JOIN x ON x.vuln_id = v.vuln_id AND x.purl = c.purl LEFT JOIN w ON w.vuln_id = v.vuln_id) "
    "SELECT sbom_id, component_id, vuln_id, coalesce(vex_status, '') AS vex_status FROM j WHERE coalesce(vex_status, '') NOT IN ('not_affected', 'fixed')"
)
def e_vex(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.tables(spark, sf_dir)
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n_parts"))
    e = table(spark, sf_dir, "events").where("event_type = 'click' and event_id % 5 = 0").join(F.broadcast(n))
    purls = t.components.groupBy("part_no").agg(F.min("purl").alias("min_purl"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("affected", "not_affected", "fixed", "under_investigation")]), (F.col("event_id") % 4).cast("int") + 1)
    s = e.withColumn("part_no", F.col("event_id") % F.col("n_parts")).join(purls, "part_no", "left")
    statements = s.select(F.col("event_id").alias("seq"), F.concat(F.lit("CVE-2024-"), F.lpad(F.get_json_object("props", "$.k"), 4, "0")).alias("vuln_id"), status.alias("status"), F.when(F.col("event_id") % 2 == 0, F.col("min_purl")).alias("purl"))
    out = enrichment.actionable(enrichment.with_vex(t.vulns, t.components, statements))
    return out.select("sbom_id", "component_id", "vuln_id", F.coalesce("vex_status", F.lit("")).alias("vex_status"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'archived' WHEN o_orderkey % 13 = 0 THEN 'deprecated' WHEN DATE '2001-08-01' - CAST(o_orderdate AS DATE) >= 730 THEN 'abandoned' WHEN DATE '2001-08-01' - CAST(o_orderdate AS DATE) >= 365 THEN 'stale' WHEN DATE '2001-08-01' - CAST(o_orderdate AS DATE) >= 182 THEN 'aging' ELSE 'fresh' END AS level FROM orders")
def e_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", enrichment.staleness(k % 17 == 0, k % 13 == 0, F.to_date("o_orderdate"), F.lit("2001-08-01").cast("date")).alias("level"))


_ADVISORIES = """adv AS (SELECT DISTINCT 'OSV-' || part_no AS vuln_id, purl, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS ecosystem, CAST(NULL AS VARCHAR) AS version, CAST(part_no % 10 AS DOUBLE) AS cvss FROM components WHERE part_no % 4 = 1 AND purl IS NOT NULL
  UNION ALL SELECT DISTINCT 'OSV-N' || part_no, NULL, upper(name), ecosystem, version, CAST(part_no % 10 AS DOUBLE) FROM components WHERE part_no % 4 = 2 AND version IS NOT NULL)"""


@query(f"""{M}, {_ADVISORIES}, bp AS (SELECT lower(purl) AS p, vuln_id, max(cvss) AS cvss FROM adv WHERE purl IS NOT NULL GROUP BY 1, 2), bn AS (SELECT lower(name) AS n, lower(ecosystem) AS e, version AS v, vuln_id, max(cvss) AS cvss FROM adv WHERE purl IS NULL GROUP BY 1, 2, 3, 4)
SELECT sbom_id, id, vuln_id, cvss FROM components JOIN bp ON lower(purl) = p UNION ALL SELECT sbom_id, id, vuln_id, cvss FROM components JOIN bn ON lower(name) = n AND lower(ecosystem) = e AND version = v WHERE purl IS NULL OR NOT EXISTS (SELECT 1 FROM bp WHERE p = lower(purl))""")
def e_osv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented advisories of every kind of key joined to all components."""
    c = materialize(testdata.components(spark, sf_dir), "components")
    none, k = F.lit(None).cast("string"), F.col("part_no")
    score = (k % 10).cast("double").alias("cvss")
    by_purl = c.where("part_no % 4 = 1 and purl is not null").select(F.concat(F.lit("OSV-"), k.cast("string")).alias("vuln_id"), "purl", none.alias("name"), none.alias("ecosystem"), none.alias("version"), score)
    by_name = c.where("part_no % 4 = 2 and version is not null").select(F.concat(F.lit("OSV-N"), k.cast("string")).alias("vuln_id"), none.alias("purl"), F.upper("name").alias("name"), "ecosystem", "version", score)
    return enrichment.with_advisories(c, by_purl.distinct().unionByName(by_name.distinct()))


# --- rules ------------------------------------------------------------------------
_RULES = [("npm-rings", "glob", "pkg:npm/*ring*"), ("one", "exact", "pkg:cargo/red-bolt@7.0.0"), ("sevens", "regex", "@7\\.")]


@query(f"{M} SELECT sbom_id, id, CASE WHEN regexp_matches(purl, '^pkg:npm/.*ring.*$') THEN 'npm-rings' WHEN purl = 'pkg:cargo/red-bolt@7.0.0' THEN 'one' WHEN regexp_matches(purl, '@7[.]') THEN 'sevens' END AS rule_id FROM components")
def j_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_rule(testdata.components(spark, sf_dir), _RULES).select("sbom_id", "id", "rule_id")


_ALIASES = "al AS (SELECT DISTINCT 'pkg:npm/' || replace(p_name, ' ', '-') || '@7.0.1' AS alias, 'pkg:canon/' || split_part(p_name, ' ', 2) AS canonical FROM part)"


@query(f"{M}, {_ALIASES} SELECT sbom_id, id, coalesce(canonical, purl, id) AS canonical FROM components LEFT JOIN (SELECT lower(alias) AS alias, min(canonical) AS canonical FROM al GROUP BY 1) ON lower(purl) = alias")
def j_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    aliases = table(spark, sf_dir, "part").select(F.concat(F.lit("pkg:npm/"), F.replace(name, F.lit(" "), F.lit("-")), F.lit("@7.0.1")).alias("alias"), F.concat(F.lit("pkg:canon/"), F.split(name, " ")[1]).alias("canonical")).distinct()
    return rules.canonical_ids(testdata.components(spark, sf_dir), aliases).select("sbom_id", "id", "canonical")


_FAMILIES = [("rings", "npm", "red ring", 0.95), ("rings", "pypi", "blue ring", 0.95), ("bolts", "cargo", "hot bolt", 0.85), ("bolts", "maven", "cold bolt", 0.95)]


@query(f"{M}, f(family, eco, n, score) AS (VALUES {', '.join(map(str, _FAMILIES))}) SELECT c.sbom_id, c.id, o.family, o.eco AS ecosystem, o.n AS name, round(CAST(o.score AS DOUBLE) - 0.1, 6) AS score FROM components c JOIN f ON f.eco = c.ecosystem AND f.n = lower(c.name) JOIN f o ON o.family = f.family AND o.eco <> f.eco WHERE CAST(o.score AS DOUBLE) - 0.1 >= 0.8")
def j_cross_ecosystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = spark.createDataFrame(_FAMILIES, "family string, ecosystem string, name string, score double")
    return matching.equivalents(testdata.components(spark, sf_dir), families).withColumn("score", F.round("score", 6))


@query(f"""WITH a AS (SELECT DISTINCT lower(name) AS n FROM inventory WHERE length(name) > 0), b AS (SELECT DISTINCT lower(name) AS n FROM spdx_packages WHERE length(name) > 0), x AS (SELECT n, {_GRAMS.format('n')} AS g FROM a), y AS (SELECT n, {_GRAMS.format('n')} AS g FROM b),
p AS (SELECT x.n AS p, y.n AS q, {_jaccard_sql('x.g', 'y.g')} AS jaccard FROM x JOIN y ON least(len(x.g), len(y.g)) >= 0.6 * greatest(len(x.g), len(y.g)))
SELECT i.rec_id AS left_id, s.rec_id AS right_id, round(jaccard, 9) AS jaccard FROM p JOIN inventory i ON lower(i.name) = p JOIN spdx_packages s ON lower(s.name) = q WHERE jaccard >= 0.6""")
def j_similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j_minhash(spark, sf_dir).select("left_id", "right_id", F.round("jaccard", 9).alias("jaccard"))


@query()
def j_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = table(spark, sf_dir, "inventory").select(F.col("rec_id").alias("id"), "name")
    spdx = table(spark, sf_dir, "spdx_packages").select(F.col("rec_id").alias("id"), "name")
    return rules.minhash_pairs(inv, spdx, 0.6)


@query("WITH k AS (SELECT DISTINCT lower(name) AS n, lower(name) AS known FROM spdx_packages WHERE length(name) > 0), i AS (SELECT DISTINCT rec_id, lower(name) AS n FROM inventory WHERE length(name) > 0), c AS (SELECT rec_id, n, unnest(list_distinct(list_prepend(n, [n[1:j-1] || n[j+1:] FOR j IN range(1, length(n) + 1)]))) AS cut FROM i), d AS (SELECT known, unnest(list_distinct(list_prepend(known, [known[1:j-1] || known[j+1:] FOR j IN range(1, length(known) + 1)]))) AS cut FROM k) SELECT DISTINCT CAST(rec_id AS VARCHAR) AS id, c.n AS name, known FROM c JOIN d USING (cut) WHERE c.n <> known AND levenshtein(c.n, known) <= 2 AND NOT EXISTS (SELECT 1 FROM k WHERE k.n = c.n)")
def er_typosquat(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps = table(spark, sf_dir, "inventory").select(F.lit(0).alias("sbom_id"), F.col("rec_id").cast("string").alias("id"), "name", F.lit("any").alias("ecosystem"))
    known = table(spark, sf_dir, "spdx_packages").select("name", F.lit("any").alias("ecosystem")).distinct()
    return rules.lookalikes(comps, known).select("id", "name", "known")
