import hashlib
import random
import re
import sys
from collections import Counter, defaultdict

import pytest

from genospark.llm import line_dedup as lines_module
from genospark.llm import ngram_join as join_module
from genospark.llm.components import components
from genospark.llm.common import stored
from genospark.llm.exact_dedup import exact_dedup, possibly_repeated
from genospark.llm.line_dedup import line_bitmaps, line_dedup
from genospark.llm.ngram_join import ngram_join

SCHEMA = "doc_id long, text string, group_size long, n_lines string, kept_text int, keep_bits int"
TEXTS = ["a b c", "A b c", None, "", " ", "one\n two \nTWO", "x\n" * 700 + "end", "one\n\n\nTwo", "a b c"]


def frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, 9, "x", 1, 2) for i, t in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ROWS = [*enumerate(TEXTS), (3, ""), (None, "a b c"), (None, "only")]


def test_exact_dedup_equals_brute_force(spark):
    found = Counter(tuple(r) for r in exact_dedup(frame(spark, ROWS)).collect())
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    expected = Counter()
    for i, t in ROWS:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        expected[i, keep, len(ids), i == keep, sha(t or "")] += 1
    assert found == expected


def test_exact_dedup_with_few_slots_and_hot_groups(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(3000)]
    found = exact_dedup(frame(spark, rows), max_slots=1 << 15)
    assert found.where("kept").count() == len({t for _, t in rows})
    assert {r["group_size"] for r in found.where("doc_id % 3 = 0").collect()} == {1000}


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_few_unique_rows_pass_for_repeated_ones(spark, n):
    rows = spark.range(n).selectExpr("id as doc_id", "sha2(cast(if(id % 10 = 0, id div 20, id) as string), 256) as text_sha256")
    marked = possibly_repeated(stored(rows, "test-digests"), n)
    truly = marked.groupBy("text_sha256").count().where("count > 1").agg({"count": "sum"}).first()[0]
    assert truly <= marked.where("repeated").count() <= truly + n // 200


def test_exact_dedup_by_ranges_equals_one_range(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"t{i // 2}") for i in range(2000)]
    one, many = (Counter(tuple(r) for r in exact_dedup(frame(spark, rows), max_slots=m).collect()) for m in (1 << 28, 1 << 13))
    assert one == many and sum(one.values()) == len(rows)


@pytest.mark.parametrize("kind", ["string", "int", "long", "decimal(20, 0)"])
def test_exact_dedup_keeps_the_type_of_ids_at_any_size(spark, kind):
    rows = frame(spark, [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(2000)] + [(None, "hot")])
    rows = rows.withColumn("doc_id", rows.doc_id.cast(kind))
    one, many = (exact_dedup(rows, max_slots=m) for m in (1 << 28, 1 << 13))
    assert one.schema["doc_id"].dataType == many.schema["keep_id"].dataType == rows.schema["doc_id"].dataType
    assert Counter(tuple(r) for r in one.collect()) == Counter(tuple(r) for r in many.collect())


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup(none).count() == 0
    assert line_dedup(none).count() == 0
    assert ngram_join(none).count() == 0


def brute_lines(rows, least, keep_first):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if key(line):
                where[key(line)].add((i, n))
    out = {}
    for i, t in rows:
        parts = (t or "").split("\n")
        gone = [n for n, x in enumerate(parts) if key(x) and len({d for d, _ in where[key(x)]}) >= least and not (keep_first and (i, n) == min(where[key(x)]))]
        out[i] = (len(parts), len(gone), "\n".join(x for n, x in enumerate(parts) if n not in gone))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize(("broadcast", "slots"), [(1 << 18, 1 << 28), (0, 64)])
def test_line_dedup_equals_brute_force(spark, monkeypatch, keep_first, broadcast, slots):
    monkeypatch.setattr(lines_module, "MAX_SLOTS", slots)
    monkeypatch.setattr(lines_module, "BROADCAST_KEYS", broadcast)
    rows = list(enumerate(TEXTS))
    out = line_dedup(frame(spark, rows), min_docs=2, keep_first=keep_first)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()} == brute_lines(rows, 2, keep_first)


def test_line_bitmaps_hold_only_pieces_that_lose_lines(spark):
    rows = [(1, "x\n" * 130 + "tail"), (1, "x\n" * 130 + "tail"), (2, "x"), (3, "own\n" * 5 + "\n".join(f"l{i}" for i in range(9000)) + "\nx")]
    found = {r["doc_id"]: [tuple(x) for x in r["keep_bits"]] for r in line_bitmaps(frame(spark, rows), min_docs=2).collect()}
    assert found == {1: [(0, 0), (1, 0), (2, ~3)], 2: [(0, ~1)], 3: [(9005 // 64, ~(1 << 9005 % 64))]}
    out = {r["doc_id"]: r["kept_text"] for r in line_dedup(frame(spark, rows), min_docs=2).collect()}
    assert (out[1], out[2], out[3]) == ("tail", "", rows[3][1][:-2])
    assert line_bitmaps(frame(spark, [(1, "x"), (1, "x")]), min_docs=2).count() == 0


def test_line_keys_lower_ascii_letters_only(spark):
    rows = [(1, "ÀB"), (2, "Àb"), (3, "àb"), (4, "QR İ"), (5, "qr İ")]
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup(frame(spark, rows), min_docs=2).collect()}
    assert out == {1: 1, 2: 1, 3: 0, 4: 1, 5: 1}


def brute_join(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n, words, edits, start=0):
    """Copies of one text, the k-th with some of its words replaced."""
    base = [f"w{i}" for i in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for e in range(k % (edits + 1)):
            own[(k * 17 + e * 31) % words] = f"new{k}x{e}"
        out.append((start + k, " ".join(own)))
    return out


@pytest.mark.parametrize(("cold", "block", "hot"), [(12, 400_000, 256), (2, 300, 3)])
@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, cold, block, hot, k, percent):
    monkeypatch.setattr(join_module, "HOT_ROWS", hot)
    monkeypatch.setattr(join_module, "COLD", cold)
    monkeypatch.setattr(join_module, "BLOCK_TOKENS", block)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = near_copies(40, 120, 6) + [(100 + i, f"{shared} " + " ".join(f"u{i}x{j}" for j in range(40 + i))) for i in range(15)]
    rows += [(200, None), (201, ""), (202, " \t"), (203, "Two words"), (204, "two WORDS"), (205, "one"), (206, rows[0][1].upper().lower()), (207, "long " * 5000)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(frame(spark, rows), k, percent).collect()}
    assert found == brute_join(rows, k, percent)


def test_hot_keys_are_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(join_module, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(0, n) for n in range(95)] + [(n, n) for n in range(1, 6)], "x long, y long").coalesce(1)
    rows = stored(rows, "test-rows")
    table = spark.createDataFrame([(n, f"t{n}") for n in range(4)] + [(0, "again")], "x long, told string")
    joined = join_module._meet(rows, table, "x", join_module._shared(rows, "x"), "y")
    found = Counter((r["x"], r["y"], r["told"]) for r in joined.collect())
    assert found == Counter([(0, n, t) for n in range(95) for t in ("t0", "again")] + [(n, n, f"t{n}") for n in range(1, 4)])
    hot = join_module._hot(join_module._shared(rows, "x"), "x").collect()
    assert [tuple(r) for r in hot] == [(0, 10)]


def test_ngram_join_handles_repeats_and_missing_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "z z z z")]
    found = Counter((r["doc_id"], r["component_id"]) for r in ngram_join(frame(spark, rows)).collect())
    assert found == {(5, 5): 2, (7, 5): 1, (None, 5): 1, (None, None): 1}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(300, 301)]
    nodes = sorted({x for e in links for x in e})
    ids = spark.createDataFrame([(n, 1000 - n) for n in nodes], "node long, id long")
    found = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(links, "x long, y long"), ids).collect()}
    assert found == {n: 980 if n <= 20 else 861 if n < 200 else 699 for n in nodes}


def counted(monkeypatch, *modules):
    """The names of the tables that the modules store from now on."""
    names = []
    for module in modules:
        monkeypatch.setattr(module, "stored", lambda df, name: names.append(name) or stored(df, name))
    return names


def test_components_of_stars_take_no_step(spark, monkeypatch):
    """Every file written starts processes on an executor's machine, so a step that changes nothing is left out."""
    names = counted(monkeypatch, sys.modules["genospark.llm.components"])
    links = [(1, 2), (3, 1), (1, 1), (2, 1), (10, 12), (11, 10)]
    ids = spark.createDataFrame([(n, -n) for n in (1, 2, 3, 10, 11, 12)], "node long, id long")
    found = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(links, "x long, y long"), ids).collect()}
    assert found == {1: -3, 2: -3, 3: -3, 10: -12, 11: -12, 12: -12}
    assert names == ["cc-edges", "cc-named"]


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range((20, 45, 80)[seed])]
    root = list(range(60))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {n for a, b in links if a != b for n in (a, b)}
    ids = spark.createDataFrame([(n, n) for n in range(60)], "node long, id long")
    found = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(links, "x long, y long"), ids).collect()}
    assert found == {n: find(n) for n in linked}


def test_join_stores_what_several_steps_read(spark, monkeypatch):
    """The bit tables and the links are each read by one plan, so they are parts of it."""
    names = counted(monkeypatch, join_module, sys.modules["genospark.llm.components"])
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base[:k], f"own{k}", *base[k + 1 :]])) for k in range(0, 60, 3)] + [(100 + k, f"x{k} y z") for k in range(5)]
    found = {r["doc_id"]: r["component_id"] for r in ngram_join(frame(spark, rows), k=1).collect()}
    assert found == {i: 0 if i < 100 else i for i, _ in rows}
    assert not {"join-bits", "join-node-bits", "join-doc-bits", "join-links"} & set(names)
    assert len(names) <= 33, names


def test_join_filter_shuffles_only_rows_of_pairs(spark):
    """Wide rows of sets without a candidate pair stay, and equal upper halves of tokens lose no pair."""
    near = [(5 << 32) + i for i in range(10)]
    sets = {1: near, 2: near[:9] + [(6 << 32)], **{i: [(i << 32) + j for j in range(10)] for i in range(100, 3000)}}
    rows = [(node, 10, 10, t, [1, 2, 3]) for node, t in sets.items()]
    reps = spark.createDataFrame(rows, "node long, n long, n_low int, low array<long>, high array<int>")
    pairs = spark.createDataFrame([(1, 2), (1, 100)], "x long, y long")
    assert join_module._maybe(reps, pairs.select(pairs.y.alias("node")), "node").count() < 10
    found = join_module._filtered(pairs, reps, 80).collect()
    assert [(r["x"], r["y"]) for r in found] == [(1, 2)]


def test_joins_of_small_tables_merge(spark):
    """One strategy at every size: what small inputs shuffle tells what large ones will."""
    a = spark.createDataFrame([(i % 5, i) for i in range(20)], "k long, v long")
    counts = a.groupBy("k").count().withColumnRenamed("count", "n")
    met = join_module._meet(a, a.withColumnRenamed("v", "w"), "k", counts, "v")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert met.count() == 80
