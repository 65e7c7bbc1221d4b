import random
from collections import Counter, defaultdict

import pytest

from bomloom.llm import mixing, packing, tokens

DDL = "doc_id bigint, text string, source string, n_tokens string"
PATH = tokens.TOKENIZER_FILE


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], DDL)


def random_docs(n, seed):
    r = random.Random(seed)
    return [(i, None if i % 50 == 7 else " ".join(r.choice(["alpha", "beta", "Gamma", "δ"]) for _ in range(int(r.expovariate(1 / 60)))), r.choice(["a", "a", "b", "c", None])) for i in range(n)]


def best_fit(items, capacity):
    """Plain best fit: the tightest compatible container, first opened first."""
    boxes = []
    for size, cluster in items:
        fits = [(left - size, n) for n, (left, held) in enumerate(boxes) if left >= size and (cluster is None or cluster not in held)]
        if fits:
            n = min(fits)[1]
            boxes[n][0] -= size
            boxes[n][1].add(cluster)
        else:
            boxes.append([capacity - size, {cluster}])
    return len(boxes)


@pytest.mark.parametrize("seed", range(6))
def test_as_few_containers_as_plain_best_fit(seed):
    r = random.Random(seed)
    rows = [{"doc_id": i, "source": "s", "n_tokens": r.randrange(1, 90), "copy": (r.randrange(40), 0)} for i in range(400)]
    out = packing.pack_shard(rows, 1, 100, {}, 0)
    n = Counter(x["copy"] for x in rows)
    items = sorted(((x["n_tokens"], x["copy"] if n[x["copy"]] > 1 else None) for x in rows), key=lambda x: -x[0])
    assert abs(len({o["container_id"] for o in out}) - best_fit(items, 100)) <= 2


def test_containers(spark):
    rows = random_docs(600, 1) + [(1000 + i, "the same text again", "a") for i in range(300)] + [(5000, "word " * 3000, "b")]
    sizes = spark.createDataFrame([(1, "s", 64), (2, "l", 512)], "pack_id int, label string, capacity_tokens int")
    out = packing.pack(docs(spark, rows), sizes, docs_per_shard=200).collect()
    size = {r.doc_id: r.n_tokens for r in tokens.sized(docs(spark, rows)).collect()}
    for pack_id, capacity in ((1, 64), (2, 512)):
        mine = [o for o in out if o.pack_id == pack_id]
        boxes, parts = defaultdict(list), defaultdict(list)
        for o in mine:
            boxes[o.container_id].append(o)
            parts[o.doc_id].append(o)
        assert all(sum(o.n_tokens for o in b) <= capacity for b in boxes.values())
        assert all(sorted(o.item_no for o in b) == list(range(len(b))) for b in boxes.values())
        assert all(sum(1000 <= o.doc_id < 1300 for o in b) <= 1 for b in boxes.values())
        assert set(parts) == set(size)
        for d, p in parts.items():
            p.sort(key=lambda o: o.part_no)
            assert sum(o.n_tokens for o in p) == size[d] and (len(p) == 1 or size[d] > capacity)
            assert [o.start_token for o in p] == [i * capacity for i in range(len(p))]


def test_sources_apart_and_empty(spark):
    rows = [(i, "word " * (i % 7 + 1), "a" if i % 2 else "b") for i in range(100)]
    sizes = spark.createDataFrame([(1, 50)], "pack_id int, capacity_tokens int")
    out = packing.pack(docs(spark, rows), sizes, apart={"a": {"b"}}).collect()
    kinds = defaultdict(set)
    for o in out:
        kinds[o.container_id].add(o.doc_id % 2)
    assert len(out) == 100 and all(len(k) == 1 for k in kinds.values())
    assert packing.pack(docs(spark, []), sizes).count() == 0
    assert packing.pack(docs(spark, rows), sizes.limit(0)).count() == 0


TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("missing", 0.1, 2)]


def test_mix(spark):
    rows = random_docs(3000, 2)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(docs(spark, rows), targets)
    s = {r.source: r for r in shares.collect()}
    assert s["missing"].drawn_tokens == 0 and s["missing"].short_tokens > 0
    for source, share, repeats in TARGETS[:3]:
        assert abs(s[source].actual_share - share / 0.9) < 0.01 and s[source].most_repeats <= repeats
    total = Counter()
    d = drawn.collect()
    assert len({r.doc_id for r in d}) == len(d)
    for r in d:
        total[r.source] += r.repeats * r.n_tokens
    assert {k: v.drawn_tokens for k, v in s.items() if v.drawn_tokens} == dict(total)
    assert sorted(d) == sorted(mixing.mix(docs(spark, rows), targets)[0].collect())


def test_short_sources_and_copies(spark):
    rows = [(i, f"text number {i} of a", "a") for i in range(50)] + [(100 + i, "one text", "b") for i in range(40)]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(docs(spark, rows), targets, total_tokens=400)
    s = {r.source: r for r in shares.collect()}
    assert s["b"].most_repeats == 3 and s["b"].docs_drawn == 1 and s["b"].short_tokens > 150
    assert abs(s["a"].drawn_tokens - 200) <= 8
    none, empty = mixing.mix(docs(spark, []), targets)
    assert none.count() == 0 and {r.actual_share for r in empty.collect()} == {0.0}


def test_prefix_sums(spark):
    r = random.Random(4)
    rows = [(i, r.choice("aaab"), r.randrange(9), r.random()) for i in range(2000)]
    got = {x.doc_id: x.before for x in mixing.prefix_sums(spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, key double")).collect()}
    sums, want = Counter(), {}
    for i, s, n, _ in sorted(rows, key=lambda x: (x[1], x[3])):
        want[i] = sums[s]
        sums[s] += n
    assert got == want


def test_heavier_documents_are_drawn_more_often(spark):
    """Of documents of one size, those of higher quality come first: by weight, not by order."""
    good, poor = "plain words of a text that reads well", "7;3#9 %4 1=2 {5} 8/6 &0 [2] 4|1 ?9 3~7"
    rows = [(i, f"{good} {i:04d}" if i % 2 else f"{poor} {i:04d}", "a") for i in range(1200)]
    one = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    texts = docs(spark, rows)
    drawn = mixing.mix(texts, one, total_tokens=sum(r.n_tokens for r in mixing.sized(texts).collect()) // 3)[0].collect()
    heavy = sum(r.doc_id % 2 for r in drawn) / len(drawn)
    assert 0.55 < heavy < 1 and len(drawn) > 200


def test_apart_in_a_registered_query(spark):
    from bomloom.llm import queries
    from tests.conftest import DATA

    texts = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").collect()}
    boxes = {}
    for r in queries.p7_apart(spark, DATA).collect():
        boxes.setdefault((r.pack_id, r.container_id), set()).add(texts[r.doc_id])
    assert boxes and not any(a in held and held & others for held in boxes.values() for a, others in queries.APART.items())
