"""Matching releases across tables without a common key.

Records are normalised and meet in blocks (keys that survive one slip in the
name).  How far name, supplier, ecosystem and date speak for or against a pair
is estimated from all candidate pairs (expectation maximisation).  Listings of
one release inside a table form one node.  Loopy belief propagation follows on
the candidate pairs of nodes: a node means at most one node of each other table
(one-to-one factors), and of three pairs among three nodes never exactly two
hold (transitivity factors).  Messages are exchanged through joins and windows
until they stand still; the marginals are the confidences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomloom.runtime import materialize

# Package-name parts that only tell the ecosystem, redistributors'
# purl types, words that stand for no value, and legal forms of companies.
ECOSYSTEM_AFFIXES = {
    "node": "npm", "js": "npm", "python": "pypi", "python3": "pypi", "go": "golang", "golang": "golang",
    "rust": "cargo", "rs": "cargo", "java": "maven", "net": "nuget", "dotnet": "nuget",
}
ECOSYSTEM_HOSTS = {"npm": "npm", "pypi": "pypi", "maven": "maven", "crates": "cargo", "gomod": "golang", "nuget": "nuget"}
REDISTRIBUTORS = {"deb", "rpm", "apk", "generic", "github", "docker", "oci"}
PLACEHOLDERS = {"", "noassertion", "none", "null", "unknown", "n/a", "na", "tbd", "latest", "-", "?"}
LEGAL_FORMS = {"ltd", "inc", "llc", "gmbh", "ab", "ag", "bv", "sa", "co", "corp", "plc", "b", "v", "s", "a"}

_FOLD = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe"})


def folded(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text.lower().translate(_FOLD))
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def version_of(text: str | None) -> str | None:
    """The version without prefixes, epoch, build and packaging marks; None if there is none."""
    if text is None:
        return None
    t = re.sub(r"^\s*\d+:(?=\d)", "", folded(text).strip())
    m = re.search(r"\d+(?:[._]\d+)*", t)
    if not m:
        return None
    numbers = [int(x) for x in re.split(r"[._]", m[0])]
    while len(numbers) > 1 and numbers[-1] == 0:
        numbers.pop()
    pre = re.match(r"[\s._-]*(alpha|beta|rc|pre|preview|dev|snapshot|m)[\s._-]*(\d*)\b", t[m.end() :])
    return ".".join(map(str, numbers)) + (f"-{pre[1]}{pre[2]}" if pre else "")


def supplier_of(text: str | None) -> list[str]:
    """The words of a supplier's name without legal form; a domain stands for its first label."""
    if text is None:
        return []
    t = folded(re.sub(r"^\s*(?:organization|person|tool)\s*:\s*", "", text, flags=re.I)).strip()
    if t in PLACEHOLDERS:
        return []
    if "." in t and not re.search(r"\s", t) and re.fullmatch(r"[\w-]+(?:\.[\w-]+)+", t):
        t = t.split(".")[0]
    words = re.findall(r"[^\W_]+", t)
    while len(words) > 1 and words[-1] in LEGAL_FORMS:
        words.pop()
    return words


def name_of(text: str | None, eco: str | None, families: set[str]) -> tuple[list[str], str | None]:
    """The words of a package name without ecosystem affixes and supplier, and the ecosystem they tell."""
    words = re.findall(r"[^\W_]+", folded(text or ""))
    told = None
    for end in (0, -1):
        if len(words) > 1 and words[end] in ECOSYSTEM_AFFIXES:
            told = ECOSYSTEM_AFFIXES[words[end]]
            del words[end]
            if told == "maven" and words[0].startswith("lib") and len(words[0]) > 5:
                words[0] = words[0][3:]
    if words and told is None and eco in (None, "pypi") and words[0].startswith("py") and len(words[0]) > 5:
        words[0], told = words[0][2:], "pypi"
    if len(words) > 2 and words[0] in families:
        del words[0]
    return words, eco or told


def purl_parts(purl: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(type, namespace, name, version) of a freely written purl."""
    m = re.match(r"\s*<?\s*pkg:\s*/*([^/?#@]+)/(.*)$", purl or "", flags=re.I | re.S)
    if not m:
        return None, None, None, None
    rest = re.split(r"[?#]", m[2])[0].strip().strip("/>")
    path, _, version = rest.rpartition("@") if "@" in rest.lstrip("@") else (rest, "", "")
    spaces, _, name = path.rpartition("/")
    return m[1].strip().lower(), unquote(spaces).strip("@/") or None, unquote(name), unquote(version) or None


_NORM = pa.schema(
    [
        ("rec_id", pa.int64()),
        ("src", pa.int32()),
        ("words", pa.list_(pa.string())),
        ("version", pa.string()),
        ("family", pa.string()),
        ("supplier", pa.string()),
        ("eco", pa.string()),
        ("day", pa.int32()),
        ("letters", pa.string()),
        ("families", pa.list_(pa.string())),
    ]
)
_NORM_DDL = "rec_id bigint, src int, words array<string>, version string, family string, supplier string, eco string, day int, letters string, families array<string>"


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _NORM]
        for rec, src, name, version, supplier, eco, space, purl, day in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if purl is not None:
                eco, space, name, version = purl_parts(purl)
            eco = None if eco is None or eco.lower() in REDISTRIBUTORS | PLACEHOLDERS else eco.lower()
            given = supplier_of(supplier)
            spaces = [w for w in re.split(r"[/.]", folded(space)) if w] if space else []
            family = spaces[-1] if spaces else given[0] if given else None
            words, eco = name_of(name, eco, {*spaces, *given[:1]})
            row = (rec, src, words, version_of(version), family, "".join(given) or None, eco, day, "".join(sorted("".join(words))), sorted({*spaces[-1:], *given[:1]}))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _NORM, strict=True)], schema=_NORM)


def _joined(words: Column) -> Column:
    return F.array_join(words, "")


def _forms(words: Column) -> Column:
    """The spellings of a name as one word: as given, first two words swapped, first word dropped (it may be a supplier)."""
    at, rest = lambda i: F.element_at(words, i), lambda i: F.slice(words, i, F.size(words))
    two = F.when(F.size(words) > 1, F.concat(at(2), at(1), _joined(rest(3))))
    three = F.when(F.size(words) > 2, _joined(rest(2)))
    swapped = F.when(F.size(words) > 2, F.concat(at(3), at(2), _joined(rest(4))))
    return F.array_distinct(F.array_compact(F.array(_joined(words), two, three, swapped)))


def _slip_keys(word: Column) -> Column:
    """The word and what is left of it without one letter (no digit): equal for words one slip apart."""
    places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: ~F.substring(word, i, F.lit(1)).between("0", "9"))
    cuts = F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cuts))


def _keys(version: Column) -> Column:
    """Block keys of a record's words and families within a version: slips of its spellings, supplier with word, supplier with prefix."""
    forms = _forms(F.col("words"))
    slips = F.transform(F.flatten(F.transform(forms, _slip_keys)), lambda s: F.xxhash64(version, F.lit("n"), s))
    by_word = F.flatten(F.transform("families", lambda f: F.transform("words", lambda w: F.xxhash64(version, F.lit("s"), f, w))))
    by_start = F.flatten(F.transform("families", lambda f: F.transform(forms, lambda w: F.xxhash64(version, F.lit("p"), f, F.substring(w, 1, 3)))))
    return F.array_distinct(F.concat(slips, by_word, by_start))


def one_slip(a: str, b: str) -> int:
    """0 if equal, 1 if one letter was added, lost, changed or two neighbours were swapped, else 2; digits must agree."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1 or [c for c in a if c.isdigit()] != [c for c in b if c.isdigit()]:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]:
        return 1
    swapped = len(a) == len(b) and a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return 1 if swapped else 2


def _shortened(a: str, b: str) -> bool:
    """One word is a shortening of the other: same first letter, letters in order, same number behind."""
    ma, mb = re.fullmatch(r"(\D+)(\d*)", a), re.fullmatch(r"(\D+)(\d*)", b)
    if not ma or not mb or ma[2] != mb[2]:
        return False
    short, full = sorted((ma[1], mb[1]), key=len)
    if len(short) < 2 or short[0] != full[0] or len(full) - len(short) < 2:
        return False
    rest = iter(full)
    return all(c in rest for c in short)


def name_distance(a: list[str], b: list[str], fam_a: str | None, fam_b: str | None) -> int | None:
    """0 same name, 1 one slip or one shortened word, 2 two slips in different words, None another name."""
    best = 3
    variants = []
    for own, other in ((a, fam_b), (b, fam_a)):
        kept = [own]
        if len(own) > 2 and other is not None and one_slip(own[0], other) < 2:
            kept.append(own[1:])
        variants.append(kept)
    for x in variants[0]:
        for y in variants[1]:
            fx, fy = "".join(x), "".join(y)
            sx = "".join([x[1], x[0], *x[2:]]) if len(x) > 1 else fx
            sy = "".join([y[1], y[0], *y[2:]]) if len(y) > 1 else fy
            whole = min(one_slip(fx, fy), one_slip(sx, fy), one_slip(fx, sy))
            best = whole if whole < min(best, 2) else best
            if len(x) == len(y) > 1 and best > 0:
                for z in (y, [y[1], y[0], *y[2:]]):
                    costs = [0 if p == q else 1 if one_slip(p, q) == 1 or _shortened(p, q) else 9 for p, q in zip(x, z, strict=True)]
                    best = min(best, sum(costs))
    return best if best <= 2 else None


def supplier_agreement(fa: str | None, sa: str | None, fb: str | None, sb: str | None) -> int:
    """1 agree, 0 unknown, -1 differ."""
    xs, ys = [x for x in (fa, sa) if x], [y for y in (fb, sb) if y]
    if not xs or not ys:
        return 0
    for x in xs:
        for y in ys:
            short, full = sorted((x, y), key=len)
            if one_slip(x, y) < 2 or (len(short) > 3 and any(one_slip(short, full[:n]) < 2 for n in (len(short) - 1, len(short), len(short) + 1))):
                return 1
    return -1


NEAR_DAYS = 7
#: What is compared, with the number of its levels; a level of -1 is unknown and counts neither way.
EVIDENCE = {"name": 4, "supplier": 2, "eco": 2, "day": 2, "namesake": 2}
#: No piece of evidence counts for more than this in log-odds.
BOUND = 6.0
#: Where estimation starts, and ``PSEUDO`` pairs' weight of it for small tables: shares of the levels among pairs that mean one release, and among others.
START = {
    "name": ((0.80, 0.15, 0.04, 0.01), (0.55, 0.15, 0.10, 0.20)), "supplier": ((0.97, 0.03), (0.10, 0.90)), "eco": ((0.99, 0.01), (0.25, 0.75)),
    "day": ((0.98, 0.02), (0.05, 0.95)), "namesake": ((0.95, 0.05), (0.60, 0.40)),
}
PSEUDO = 20.0

_PATTERN = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((f, pa.int32()) for f in EVIDENCE)])
_PATTERN_DDL = "a bigint, b bigint, " + ", ".join(f"{f} int" for f in EVIDENCE)


def _compare(batches: Iterator[pa.RecordBatch], any_name: bool = False) -> Iterator[pa.RecordBatch]:
    """The levels of every pair; pairs of other names only with ``any_name``."""
    for batch in batches:
        out: list[list] = [[] for _ in _PATTERN]
        for a, b, wa, wb, fa, fb, sa, sb, ea, eb, da, db, na, nb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            d = name_distance(wa, wb, fa, fb)
            if d is None:
                if not any_name:
                    continue
                d = 3
            sup = (1, -1, 0)[supplier_agreement(fa, sa, fb, sb) + 1]
            eco = -1 if ea is None or eb is None else int(ea != eb)
            day = -1 if da is None or db is None else int(abs(da - db) > NEAR_DAYS)
            namesake = int(max(na, nb) > 1) if sup == -1 and eco == -1 else -1  # other packages have this name, and nothing tells which it is
            for column, value in zip(out, (a, b, d, sup, eco, day, namesake), strict=True):
                column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PATTERN, strict=True)], schema=_PATTERN)


def estimate(patterns: list[tuple[int, ...]], rounds: int = 100) -> tuple[float, dict[str, list[float]]]:
    """Base log-odds and the log-odds of every level, from ``(*levels, number of pairs)`` of all candidate pairs.

    Expectation maximisation of two classes of pairs whose evidence is
    independent within the class.  ``START`` counts like ``PSEUDO`` pairs, so that
    small tables give sensible weights; weights are bounded by ``BOUND``.
    """
    x = np.array([p[:-1] for p in patterns], dtype=int).reshape(-1, len(EVIDENCE))
    n = np.array([p[-1] for p in patterns], dtype=float)
    m, u = ({f: np.array(START[f][k]) for f in EVIDENCE} for k in (0, 1))
    pi = 0.5
    for _ in range(rounds):
        logit = np.full(len(n), np.log(pi / (1 - pi)))
        for k, f in enumerate(EVIDENCE):
            known = x[:, k] >= 0
            logit[known] += np.log(m[f] / u[f])[x[known, k]]
        r = 1 / (1 + np.exp(-logit))
        for k, f in enumerate(EVIDENCE):
            known = x[:, k] >= 0
            for share, weight, start in ((m, r, START[f][0]), (u, 1 - r, START[f][1])):
                total = np.bincount(x[known, k], (n * weight)[known], EVIDENCE[f]) + PSEUDO * np.array(start)
                share[f] = total / total.sum()
        pi = (float((n * r).sum()) + PSEUDO / 2) / (float(n.sum()) + PSEUDO)
    return float(np.clip(np.log(pi / (1 - pi)), -BOUND, BOUND)), {f: np.clip(np.log(m[f] / u[f]), -BOUND, BOUND).tolist() for f in EVIDENCE}


def base_odds(patterns: list[tuple[int, ...]], weights: dict[str, list[float]], rounds: int = 50) -> float:
    """The base log-odds of another set of pairs under known weights."""
    n = np.array([p[-1] for p in patterns], dtype=float)
    own = np.array([sum(weights[f][v] for f, v in zip(EVIDENCE, p, strict=False) if v >= 0) for p in patterns])
    pi = 0.5
    for _ in range(rounds):
        pi = (float((n / (1 + np.exp(-own) * (1 - pi) / pi)).sum()) + PSEUDO / 2) / (float(n.sum()) + PSEUDO)
    return float(np.clip(np.log(pi / (1 - pi)), -BOUND, BOUND))


def _counts(pairs: DataFrame) -> list[tuple[int, ...]]:
    """Pairs by pattern: at most as many rows as there are combinations of levels."""
    return [tuple(r) for r in pairs.groupBy(*EVIDENCE).agg(F.count("*").alias("n")).orderBy(*EVIDENCE).collect()]


def _log_odds(base: float, weights: dict[str, list[float]]) -> Column:
    total = F.lit(base)
    for f, w in weights.items():
        total = total + F.when(F.col(f) >= 0, F.get(F.array(*[F.lit(x) for x in w]), F.col(f))).otherwise(0.0)
    return total


def _completed(rows: DataFrame) -> DataFrame:
    """Correct slips in suppliers, fill in a supplier or ecosystem where a name's other records leave one possibility, count namesakes.

    A first word that is the supplier of the package that the other words name is
    taken for the supplier.
    """
    named = rows.where("family is not null").select("letters", "family").distinct().withColumnsRenamed({"letters": "rest", "family": "first"}).withColumn("led", F.lit(True))
    tail = F.slice("words", 2, F.size("words"))
    split = rows.withColumn("first", F.when(F.col("family").isNull() & (F.size("words") > 2), F.col("words")[0])).withColumn("rest", F.array_join(F.array_sort(F.split(_joined(tail), "")), ""))
    split = split.join(named, ["rest", "first"], "left").withColumn("led", F.coalesce("led", F.lit(False)))
    rows = split.withColumns({
        "family": F.when(F.col("led"), F.col("first")).otherwise(F.col("family")), "words": F.when(F.col("led"), tail).otherwise(F.col("words")), "letters": F.when(F.col("led"), F.col("rest")).otherwise(F.col("letters")),
        "families": F.when(F.col("led"), F.array("first")).otherwise(F.col("families")),
    }).drop("first", "rest", "led")
    rows = materialize(rows, "led")
    known = rows.where("family is not null and eco is not null").groupBy("letters", "family", "eco").agg(F.count("*").alias("n"))
    # a family seen less often beside another of its ecosystem is taken for a slip
    top = materialize(known.groupBy("letters", "eco").agg(F.max_by("family", F.struct("n", "family")).alias("eco_family"), F.max("n").alias("n")), "packages")
    families = top.groupBy("letters", F.col("eco_family").alias("family")).agg(F.max_by("eco", F.struct("n", "eco")).alias("family_eco"))
    packages = top.groupBy("letters").agg(F.count("*").alias("namesakes"))
    odd = rows.where("family is not null").select("letters", "family").distinct().join(families, ["letters", "family"], "left_anti")
    near = odd.select("letters", "family", F.explode(_slip_keys(F.col("family"))).alias("slip")).join(
        families.select("letters", F.col("family").alias("better"), F.explode(_slip_keys(F.col("family"))).alias("slip")), ["letters", "slip"]
    )
    fixed = near.groupBy("letters", "family").agg(F.min("better").alias("better"))
    rows = rows.join(fixed, ["letters", "family"], "left").withColumn("family", F.coalesce("better", "family")).drop("better")
    filled = rows.join(top.drop("n"), ["letters", "eco"], "left").join(families, ["letters", "family"], "left").join(packages, "letters", "left")
    return filled.select(
        "rec_id", "src", "words", "version", F.coalesce("family", "eco_family").alias("family"), "supplier", F.coalesce("eco", "family_eco").alias("eco"),
        "day", F.coalesce("namesakes", F.lit(1)).alias("namesakes"), "families",
    )


def _own_words(rows: DataFrame) -> DataFrame:
    """``rec_id, word``: the word of a record's name that stands beside the fewest other words.

    That is the package's own word: common nouns and their shortenings stand
    beside many words, at any size of the data.  Ties give a row each.
    """
    words = rows.select("rec_id", "words", F.explode(F.array_distinct("words")).alias("word"))
    beside = words.select("word", F.explode("words").alias("other")).where("word <> other").distinct().groupBy("word").agg(F.count("*").alias("n"))
    counted = words.drop("words").join(beside, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fewest = counted.withColumn("least", F.min("n").over(Window.partitionBy("rec_id")))
    return fewest.where("n = least").select("rec_id", "word")


def _side(rows: DataFrame, s: str) -> DataFrame:
    names = {"rec_id": s, "words": f"w{s}", "family": f"f{s}", "supplier": f"s{s}", "eco": f"e{s}", "day": f"d{s}", "namesakes": f"n{s}"}
    return rows.select(*[F.col(k).alias(v) for k, v in names.items()])


def _patterns(pairs: DataFrame, rows: DataFrame, any_name: bool = False) -> DataFrame:
    full = pairs.join(_side(rows, "a"), "a").join(_side(rows, "b"), "b")
    columns = full.select("a", "b", "wa", "wb", "fa", "fb", "sa", "sb", "ea", "eb", "da", "db", "na", "nb")
    return columns.mapInArrow(partial(_compare, any_name=any_name), _PATTERN_DDL)


def _meet(keyed: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of (key, rec_id) that share a key."""
    both = keyed.select("key", F.col("rec_id").alias("a")).join(keyed.select("key", F.col("rec_id").alias("b")), "key")
    return both.where("a < b").select("a", "b").distinct()


def _single_release(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of a record without version and a record of its package, where the package has just one release.

    Packages are compared by their spellings (names with supplier and ecosystem),
    not by records, so that a package with many releases costs one row.
    """
    spelling = ["words", "family", "supplier", "eco"]
    mark = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in spelling])
    rows = rows.withColumn("spelling", mark)
    packages = rows.groupBy("spelling").agg(
        F.min("rec_id").alias("rec_id"), *[F.first(c, True).alias(c) for c in (*spelling, "families")], F.first("namesakes").alias("namesakes"),
        F.min("version").alias("least"), F.max("version").alias("most"), F.max(F.col("version").isNull()).alias("open"),
    ).withColumn("day", F.lit(None).cast("int"))
    packages = materialize(packages, "spellings")
    any_version = F.lit("*")
    by_word = packages.join(own, "rec_id").select("rec_id", "open", F.xxhash64(any_version, F.lit("o"), "word").alias("key"))
    keyed = packages.select("rec_id", "open", F.explode(_keys(any_version)).alias("key")).unionByName(by_word)
    near = keyed.where("open").select("key", F.col("rec_id").alias("a")).join(keyed.select("key", F.col("rec_id").alias("b")), "key").select("a", "b").distinct()
    # as in the estimate's start: which package is meant doesn't depend on dates
    start = {f: np.log(np.array(START[f][0]) / np.array(START[f][1])).tolist() for f in EVIDENCE}
    same = _patterns(near, packages).where(_log_odds(0.0, start) > 0).select("a", "b")
    range_of = packages.select(F.col("rec_id").alias("b"), "least", "most", F.col("spelling").alias("to"))
    seen = same.join(range_of, "b")
    lone = seen.groupBy("a").agg(F.min("least").alias("low"), F.max("most").alias("high")).where("low is null or low = high").select("a")
    ways = seen.join(lone, "a").join(packages.select(F.col("rec_id").alias("a"), "spelling"), "a").select("spelling", "to")
    blank = rows.where("version is null").select("spelling", F.col("rec_id").alias("x"))
    pairs = ways.join(blank, "spelling").select("x", F.col("to").alias("spelling")).join(rows.select("spelling", F.col("rec_id").alias("y")), "spelling").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _nodes(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """``rec_id, node``: listings of one table that mean one release share a node, named by its smallest id.

    Linked records form components; where a component shows several suppliers or
    ecosystems, each of them is a node, and records that name none stay alone.
    """
    both = linked.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(linked.select(F.col("b").alias("x"), F.col("a").alias("y")))
    both = materialize(both, "links")
    labels, n = both.select(F.col("x").alias("rec_id"), F.col("x").alias("label")).distinct(), 0
    while True:
        n += 1
        offer = both.join(labels, both.y == labels.rec_id).groupBy("x").agg(F.min("label").alias("offer"))
        closer = labels.join(offer, labels.rec_id == offer.x).select("rec_id", F.least("label", "offer").alias("label"), F.col("label").alias("was"))
        jump = closer.select(F.col("rec_id").alias("label"), F.col("label").alias("further"))
        new = materialize(closer.join(jump, "label").select("rec_id", F.least("label", "further").alias("label"), "was"), f"labels-{n}")
        labels = new.select("rec_id", "label")
        if new.where("label <> was").isEmpty():
            break
    told = rows.join(labels, "rec_id").select("rec_id", "label", "family", "eco")
    shown = told.groupBy("label").agg(F.count_distinct("family").alias("families"), F.count_distinct("eco").alias("ecos"))
    told = told.join(shown, "label")
    mark = lambda c, n: F.when(F.col(n) > 1, F.coalesce(F.concat(F.lit("v"), c), F.concat(F.lit("r"), F.col("rec_id").cast("string")))).otherwise("")
    told = told.withColumn("node", F.min("rec_id").over(Window.partitionBy("label", mark("family", "families"), mark("eco", "ecos"))))
    return rows.select("rec_id", "src").join(told.select("rec_id", "node"), "rec_id", "left").select("rec_id", "src", F.coalesce("node", "rec_id").alias("node"))


def _twins(prior: DataFrame) -> DataFrame:
    """``a, b, shared``: records of one table that are candidates of the same record, each with that record's likeliest one.

    Both mean the record's release with at least ``shared`` log-odds, so they are
    one release if that outweighs what speaks against the pair itself.
    """
    ways = prior.select(F.col("a").alias("mid"), F.col("b").alias("x"), F.col("src_b").alias("src"), "prior")
    ways = ways.unionByName(prior.select(F.col("b").alias("mid"), F.col("a").alias("x"), F.col("src_a").alias("src"), "prior")).where("prior > 0")
    best = ways.withColumn("top", F.max_by("x", F.struct("prior", -F.col("x"))).over(Window.partitionBy("mid", "src"))).where("x <> top")
    return best.groupBy(F.least("x", "top").alias("a"), F.greatest("x", "top").alias("b")).agg(F.max("prior").alias("shared"))


_LIMIT = 30.0


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _one_to_one(edges: DataFrame, me: str, other: str) -> Column:
    """Message of a node's factor for one other table to an edge: what the other edges leave to it, of which at most one may hold."""
    group = Window.partitionBy(me, f"src_{other}")
    weight = F.exp(F.greatest(F.least(F.col("belief") - F.col(f"to_{me}"), F.lit(_LIMIT)), F.lit(-_LIMIT)))
    rest = F.sum(weight).over(group) - weight
    return F.when(F.count("*").over(group) > 1, -F.log1p(F.greatest(rest, F.lit(0.0)))).otherwise(0.0)


def _transitive(x: Column, y: Column, slack: float) -> Column:
    """Message of a transitivity factor to an edge, from the odds of the two others: exactly two of three edges are ``slack`` likely."""
    return F.log((1 + slack * x + slack * y + x * y) / (1 + x + y + slack * x * y))


def one_to_one_beliefs(edges: DataFrame, max_rounds: int = 8, tolerance: float = 0.001, damping: float = 0.1, slack: float = 0.001) -> DataFrame:
    """``a, b, prior, confidence``: marginals of loopy belief propagation over candidate edges.

    ``edges``: ``a, b, src_a, src_b, prior`` (log-odds), one row a pair.  A node
    has a one-to-one factor for each other table; every triangle of edges has a
    transitivity factor.  An edge's belief is its prior plus all messages to it;
    it sends each factor its belief without that factor's own message.  Edges
    without rivals and triangles need no messages.  Damped messages are exchanged
    until no marginal moves by more than ``tolerance``, or for ``max_rounds``; the
    damping grows, so that contradictory loops come to rest too.
    """
    zero = F.lit(0.0)
    edges = edges.select("a", "b", "src_a", "src_b", "prior")
    way = lambda d, x, y: d.select(F.col("a").alias(x), F.col("b").alias(y), F.col("src_a").alias(f"s{x}"), F.col("src_b").alias(f"s{y}"))
    closed = way(edges, "x", "y").join(way(edges, "x", "z").drop("sx"), "x").where("y < z and sy <> sz")
    closed = closed.join(edges.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"]).select("x", "y", "z")
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(p).alias("a"), F.col(q).alias("b")) for i, (p, q) in enumerate(("xy", "xz", "yz"))])
    corners = materialize(closed.select("x", "y", "z", F.explode(sides).alias("e"), zero.alias("message")).select("x", "y", "z", "e.side", "e.a", "e.b", "message"), "triangles")
    state = materialize(edges.withColumns({"to_a": zero, "to_b": zero, "to_t": zero, "belief": F.col("prior")}), "beliefs-0")
    for n in range(1, max_rounds + 1):
        keep = 1 - (1 - damping) * 0.85 ** (n - 1)
        # factors of triangles: every edge tells its belief without the factor's last message
        told = corners.join(state.select("a", "b", "belief"), ["a", "b"])
        odds = F.exp(F.greatest(F.least(F.col("belief") - F.col("message"), F.lit(_LIMIT)), F.lit(-_LIMIT)))
        held = told.groupBy("x", "y", "z").agg(*[F.max(F.when(F.col("side") == i, odds)).alias(f"o{i}") for i in range(3)], *[F.max(F.when(F.col("side") == i, F.col("message"))).alias(f"m{i}") for i in range(3)])
        fresh = [keep * F.col(f"m{i}") + (1 - keep) * _transitive(F.col(f"o{j}"), F.col(f"o{k}"), slack) for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1))]
        out = F.array(*[F.struct(F.lit(i).alias("side"), F.col(p).alias("a"), F.col(q).alias("b"), fresh[i].alias("message")) for i, (p, q) in enumerate(("xy", "xz", "yz"))])
        corners = materialize(held.select("x", "y", "z", F.explode(out).alias("e")).select("x", "y", "z", "e.*"), f"triangles-{n}")
        sums = corners.groupBy("a", "b").agg(F.sum("message").alias("new_t"))
        new = state.withColumn("new_a", _one_to_one(state, "a", "b")).withColumn("new_b", _one_to_one(state, "b", "a")).join(sums, ["a", "b"], "left")
        mixed = lambda s: keep * F.col(f"to_{s}") + (1 - keep) * F.col(f"new_{s}")
        new = new.withColumns({"next_a": mixed("a"), "next_b": mixed("b"), "next_t": F.coalesce("new_t", zero)})
        belief = F.col("prior") + F.col("next_a") + F.col("next_b") + F.col("next_t")
        moved = F.abs(_sigmoid(belief) - _sigmoid(F.col("belief")))
        new = new.select("a", "b", "src_a", "src_b", "prior", F.col("next_a").alias("to_a"), F.col("next_b").alias("to_b"), F.col("next_t").alias("to_t"), belief.alias("belief"), moved.alias("moved"))
        state = materialize(new, f"beliefs-{n}")
        if (state.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
        state = state.drop("moved")
    return state.select("a", "b", "prior", _sigmoid(F.col("belief")).alias("confidence"))


def _closing(edges: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of two tables that have a neighbour in the third table in common and are no edge yet."""
    ways = edges.select(F.col("a").alias("x"), F.col("b").alias("mid"), F.col("src_a").alias("s"), F.col("src_b").alias("sm"))
    ways = ways.unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("mid"), F.col("src_b").alias("s"), F.col("src_a").alias("sm")))
    two = ways.join(ways.select("mid", F.col("x").alias("y"), F.col("s").alias("t")), "mid").where("x < y and s <> t")
    return two.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().join(edges.select("a", "b"), ["a", "b"], "left_anti")


def release_graph(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidate edges between nodes (``a, b, src_a, src_b, prior``) and the ``rec_id, node`` of every record.

    Edges are all candidate pairs of two tables, contradicting ones included,
    and the pairs that close a triangle of them.
    """
    norm = listings.select("rec_id", "src", "name", "version", "supplier", "eco", "space", "purl", "day").mapInArrow(_normalise, _NORM_DDL)
    norm = materialize(norm.where(F.size("words") > 0), "normalised")
    same = ["src", "words", "version", "family", "supplier", "eco", "day"]
    alike = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) if c not in ("words", "src") else F.col(c) for c in same]
    member = norm.select("rec_id", F.xxhash64(F.lit(1), *alike).alias("h1"), F.xxhash64(*alike, F.lit(2)).alias("h2"))
    members = materialize(member.select("rec_id", F.min("rec_id").over(Window.partitionBy("h1", "h2")).alias("first_id")), "members")
    rows = materialize(_completed(norm.join(members.where("rec_id = first_id").select("rec_id"), "rec_id", "left_semi")), "completed")
    own = materialize(_own_words(rows), "own-words")
    dated = rows.where("version is not null")
    by_word = dated.join(own, "rec_id").select("rec_id", F.xxhash64("version", F.lit("o"), "word").alias("key"))
    keyed = dated.select("rec_id", F.explode(_keys(F.col("version"))).alias("key")).unionByName(by_word)
    patterns = _patterns(_meet(keyed).unionByName(_single_release(rows, own)), rows)
    src = lambda x: rows.select(F.col("rec_id").alias(x), F.col("src").alias(f"src_{x}"))
    patterns = materialize(patterns.join(src("a"), "a").join(src("b"), "b"), "patterns")
    across, within = patterns.where("src_a <> src_b"), patterns.where("src_a = src_b")
    base, weights = estimate(_counts(across))
    within_base = base_odds(_counts(within), weights)
    linked = within.where(_log_odds(within_base, weights) > 0).select("a", "b")
    prior = materialize(across.select("a", "b", "src_a", "src_b", _log_odds(base, weights).alias("prior")), "priors")
    twins = _twins(prior)
    told = _patterns(twins.select("a", "b"), rows, any_name=True).join(twins, ["a", "b"])
    linked = linked.unionByName(told.where(_log_odds(within_base, weights) + F.col("shared") > 0).select("a", "b")).distinct()
    nodes = materialize(_nodes(rows, linked), "nodes")
    of = lambda x: nodes.select(F.col("rec_id").alias(x), F.col("node").alias(f"n{x}"))
    prior = prior.join(of("a"), "a").join(of("b"), "b")
    turned = F.col("na") > F.col("nb")
    pick = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p))
    edges = prior.select(pick("na", "nb").alias("a"), pick("nb", "na").alias("b"), pick("src_a", "src_b").alias("src_a"), pick("src_b", "src_a").alias("src_b"), "prior")
    edges = materialize(edges.groupBy("a", "b").agg(F.first("src_a").alias("src_a"), F.first("src_b").alias("src_b"), F.max("prior").alias("prior")), "edges")
    more = _patterns(_closing(edges), rows, any_name=True).join(src("a"), "a").join(src("b"), "b").select("a", "b", "src_a", "src_b", _log_odds(base, weights).alias("prior"))
    edges = materialize(edges.unionByName(more), "all-edges")
    places = members.join(nodes.select(F.col("rec_id").alias("first_id"), "node"), "first_id").select("rec_id", "node")
    return edges, places


def match_releases(listings: DataFrame, **belief_options) -> DataFrame:
    """``rec_id_a, rec_id_b, confidence`` of cross-table pairs that may mean one release, smaller id first.

    ``listings``: ``rec_id`` (unique), ``src`` (the table), ``name, version,
    supplier, eco, space, purl, day``; where ``purl`` is given it tells name,
    version, ecosystem and supplier's namespace.  Confidences are the marginals
    of the belief propagation over the nodes that the records belong to.

    * The version must agree after prefixes, epoch, build and packaging marks
      are dropped; a record without one matches if the records of its package
      show at most one version.
    * Records whose normalised values agree in everything, and listings of a
      table that mean one release, are one node and are given back one by one.
    * Records without a usable name match nothing; null, empty and placeholder
      values are unknown and count neither way.  Pairs in one table aren't given.
      An empty table has no pairs.
    """
    edges, places = release_graph(listings)
    beliefs = one_to_one_beliefs(edges, **belief_options)
    left = places.select(F.col("node").alias("a"), F.col("rec_id").alias("ra"))
    right = places.select(F.col("node").alias("b"), F.col("rec_id").alias("rb"))
    out = beliefs.join(left, "a").join(right, "b")
    return out.select(F.least("ra", "rb").alias("rec_id_a"), F.greatest("ra", "rb").alias("rec_id_b"), "confidence")


def listings(inventory: DataFrame, spdx_packages: DataFrame, vuln_components: DataFrame) -> DataFrame:
    """The three tables in one shape."""
    text, day = F.lit(None).cast("string"), lambda c: F.unix_date(F.col(c).cast("date")).alias("day")
    host = F.regexp_extract("download_location", r"^https?://([^./]+)\.", 1)
    hosts = F.create_map(*[F.lit(x) for pair in ECOSYSTEM_HOSTS.items() for x in pair])
    space = F.nullif(F.regexp_extract("download_location", r"^https?://[^/]+/([^/]+)/", 1), F.lit(""))
    inv = inventory.select("rec_id", F.lit(0).alias("src"), "name", "version", F.col("author").alias("supplier"), F.col("ecosystem").alias("eco"), text.alias("space"), text.alias("purl"), day("released_at"))
    spdx = spdx_packages.select("rec_id", F.lit(1).alias("src"), "name", F.col("version_info").alias("version"), "supplier", hosts[host].alias("eco"), space.alias("space"), text.alias("purl"), day("built_at"))
    vuln = vuln_components.select("rec_id", F.lit(2).alias("src"), text.alias("name"), text.alias("version"), F.col("publisher").alias("supplier"), text.alias("eco"), text.alias("space"), "purl", day("published_at"))
    return inv.unionByName(spdx).unionByName(vuln)

