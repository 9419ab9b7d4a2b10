import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from genospark.llm import filter_audit, importance, secrets

# Filter audit --------------------------------------------------------------------------------------------------------

PROSE = " ".join(f"w{i}" for i in range(250))


def audit_rows():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        n = rng.choice([0, 5, 199, 200, 260])
        words = [rng.choice(["a", "Bb", "ccc", f"u{rng.random()}"]) if rng.random() < 0.8 else f"x{j}" for j in range(n)]
        text = rng.choice([" ", "\n", "\t "]).join(words) + rng.choice(["", "", " $", " EEEEEEEEEEEEEEEEEEEE"])
        rows.append((i, rng.choice(["s1", "s2", "", None]), rng.choice([text, PROSE, PROSE, None, ""])))
    return [*rows, (None, "s1", PROSE), (None, "s1", "alone"), (7, "s2", PROSE), (7, "s2", PROSE), (3, None, "é" * 3000)]


LABELS = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 300, 2)] + [(4, 0, 1), (None, 1, 1), (9999, 1, 1)]


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    ids = defaultdict(list)
    for i, _, t in rows:
        ids[t or ""] += [i] if i is not None else []
    docs = []
    for i, part, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and min(ids[t]) < i,
        }
        docs.append((part or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                stay = [d for d in left if f not in d[1]]
                before = [d for d in docs if d[0] == part and d[1] & set(order[: step - 1])]
                out[part, "".join(order), step] = [
                    len(stay), len(gone), sum(f in d[1] for d in before), sum(d[1] == {f} for d in docs if d[0] == part), sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
                left = stay
    shapley = Counter()
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_every_order_by_itself(spark):
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, n int, mask string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(filter_audit.failure_counts(docs, labels)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found} == brute_audit(rows, LABELS)
    assert len(found) == 3 * 120 * 5
    none = filter_audit.failure_counts(docs.where("false"), labels.where("false"))
    assert filter_audit.audit(none).count() == 0
    assert filter_audit.failure_counts(docs.withColumn("doc_id", docs.doc_id.cast("string")), labels.withColumn("doc_id", labels.doc_id.cast("string"))).count() > 0


@pytest.mark.parametrize("k", [1, 2, 5, 7])
def test_paths_through_the_lattice_are_orders(k):
    taken = Counter()
    for order in itertools.permutations(range(k)):
        state = 0
        for f in order:
            taken[state, f] += 1
            state |= 1 << f
    assert {(s, f): n for s, f, n in filter_audit.lattice(k)} == taken


def test_audit_takes_other_filters_and_refuses_too_many(spark):
    counts = spark.createDataFrame([("p", 1, 3, 1, 0), ("p", 3, 2, 0, 2), ("p", 0, 5, 5, 0)], "part string, mask int, n long, good long, toxic long")
    found = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in filter_audit.audit(counts, "XY").collect()}
    assert found == {("XY", 1): (5, 5, 0, 3, 8), ("XY", 2): (5, 0, 2, 0, 2), ("YX", 1): (8, 2, 0, 0, 2), ("YX", 2): (5, 3, 2, 3, 8)}
    with pytest.raises(ValueError):
        filter_audit.audit(counts, "ABCDEFGH")


# Importance resampling -----------------------------------------------------------------------------------------------

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(rows, target):
    docs = [(i, *grams(t)) for i, t in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in target for b in grams(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0))))
    out, able = [], []
    for i, n, found in docs:
        weight, score = sum(map(gain, found)), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            able += [(-score, i, len(found))] if n >= 20 else []
        out.append((i, len(found), weight, score))
    rank = {r: k + 1 for k, r in enumerate(sorted(able)[: 5 * len(able) // 100])}
    return Counter((i, f, w, s, rank.get((-s, i, f)) if s is not None else None) for i, f, w, s in out)


def resample_rows():
    rng = random.Random(1)
    word = lambda: rng.choice(["Alpha", "bétà", "x" * rng.choice([62, 63, 64, 65, 200]), "the", "of", "q%d" % rng.randrange(50)])
    rows = [(i, rng.choice([" ", "-", "\n. "]).join(word() for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 60])))) for i in range(400)]
    long = " ".join(f"long{i % 997} of" for i in range(120_000)) + " " + "y" * 3_000_000 + " end"
    return [*rows, (400, None), (401, ""), (402, "..."), (None, "the " * 30), (None, None), (404, long), (3, "again")]


def test_resampling_equals_brute_force(spark):
    rows, target = resample_rows(), ["the of the of", "Alpha bétà the", None, ""]
    docs = spark.createDataFrame([(*r, 5, "w") for r in rows], "doc_id long, text string, n_words int, rank string")
    found = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    got = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect())
    assert got == brute_resample(rows, target)


def test_resampling_of_nothing_and_for_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    docs = spark.createDataFrame([(i, "a b c " * 9) for i in range(60)], "doc_id long, text string")
    found = importance.resample(docs, none).collect()
    assert len(found) == 60 and sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3]
    assert importance.resample(docs.withColumn("doc_id", docs.doc_id.cast("string")), none).count() == 60


def test_bit_planes_give_exact_weights():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 3, (7, 10000)) * rng.integers(0, 100_000, (7, 10000))
    gain = rng.integers(-20_000, 20_000, 10000)
    assert (importance.weights(counts, *importance.gain_planes(gain)) == counts @ gain).all()
    assert (importance.weights(counts, *importance.gain_planes(np.zeros(10000, np.int64))) == 0).all()


def test_pieces_cut_no_word():
    rng = random.Random(2)
    raw = b" ".join(b"v" * rng.randrange(1, 9000) for _ in range(300))
    assert [w for p in importance.pieces(raw, 1000) for w in p] == raw.split()


# Secrets -------------------------------------------------------------------------------------------------------------

CLASS = "A-Za-z0-9+/_.=-"


def brute_findings(text):
    text, out = text or "", []
    keys = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    for m in re.finditer(rf"""({keys})["']? *[:=] *["']?([{CLASS}]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


TRICKY = [
    "password: token: abcdefghij", "PassWord==abcdefgh", "api_key='short'", 'APIKEY"  =  "' + "x" * 8, "secret: secret=abcdefghi", "é token = " + "0f" * 20 + " ü",
    "AKIAAKIAAKIA1234", "AKIA" + "Z" * 11, "x" + "AKIA" + "9" * 400, "a" * 31, "a" * 32 + "g", "ſecret: abcdefghij", "toKen: abcdefghij", "token:\n abcdefghij", None, "",
    "passwd" + " " * 5000 + ":" + "deadbeef" * 900, "token=" + "1" * 70_000,
]


@pytest.mark.parametrize("text", TRICKY)
def test_findings_equal_the_patterns(text):
    assert secrets.findings(text or "") == brute_findings(text)


def noise(rng, k, of="0123456789abcdef"):
    return "".join(rng.choice(of) for _ in range(k))


@pytest.fixture(scope="module")
def marked():
    """Prose with labelled secrets and with numbers that are none."""
    rng = random.Random(5)
    words = ["lorem", "ipsum", "dolor", "consectetur", "adipiscing", "sit"]
    say = lambda: " ".join(rng.choice(words) for _ in range(6))
    rows = []
    for i in range(1200):
        thing = rng.choice(
            [f'token = "{noise(rng, 40)}"', f"card {noise(rng, 16, '0123456789')}", f"call 555-{noise(rng, 4, '0123456789')}", f"mail{i}.example.com", f"AKIA{noise(rng, 16, 'ABCDEFGHJKMNPQRSTUVWXYZ0123456789')}"]
        )
        rows.append((i, f"{say()} {thing} {say()}"))
    return rows


def test_network_finds_what_the_patterns_miss(spark, marked):
    docs = spark.createDataFrame(marked, "doc_id long, text string")
    model = secrets.fit(docs)
    assert (model.threshold <= 1).all()
    rng = random.Random(8)
    hidden = [f'pwd "{noise(rng, 40).upper()}" lorem' for _ in range(50)]
    clean = [f"lorem card {noise(rng, 16, '0123456789')} and 555-{noise(rng, 4, '0123456789')} mail7.example.com sit" for _ in range(50)]
    rows = [(i, t, 1, "keep") for i, t in enumerate([*hidden, *clean, *TRICKY])]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, spans int, other string"), model, redact="[SECRET]").orderBy("doc_id").collect()
    assert sum(len(r["spans"]) for r in found[:50]) >= 45 and not any(r["spans"] for r in found[50:100])
    assert "[SECRET]" in found[0]["redacted"] and found[60]["redacted"] == clean[10] and found[0]["other"] == "keep"
    for text, r in zip(TRICKY, found[100:], strict=True):
        own = [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["kind"] != secrets.ADDED]
        assert own == brute_findings(text)


def platt(logit, y):
    """Slope, offset and threshold of one kind by plain Newton steps and a sorted list."""
    ones, (a, b) = int(y.sum()), (1.0, 0.0)
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    chance = lambda: 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
    for _ in range(50):
        p = chance()
        w, e = np.maximum(p * (1 - p), 1e-9), p - target
        hessian = [[(w * logit * logit).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-3]]
        step = np.linalg.solve(hessian, [(e * logit).sum(), e.sum()]).clip(-1, 1)
        a, b = a - step[0], b - step[1]
    p = chance()
    each = np.unique(p)[::-1]
    precision = np.array([y[p >= t].mean() if y[p >= t].sum() >= secrets.MIN_RECALL * ones else 0 for t in each])
    found = np.flatnonzero(precision == precision.max())
    low = each[found[-1] + 1] if found[-1] + 1 < len(each) else 0.0
    return a, b, np.clip(0.5, (low + each[found[-1]]) / 2, each[found[0]])


def test_network_learns_from_all_windows(spark, marked):
    """Parts of 150 windows, of which a kind has more: all of those left aside calibrate, and what is found is the same."""
    docs = spark.createDataFrame(marked, "doc_id long, text string").repartition(3)
    model = secrets.fit(docs, 150)
    rows = sorted((r["window"], r["kinds"]) for r in secrets.labelled_windows(docs).collect())
    aside = [r for r in rows if zlib.crc32(r[0].encode()) // 7 % secrets.ASIDE == 0]
    assert len(aside) > 250
    logit = model.network.logits(secrets.encoded([w for w, _ in aside])).astype(float)
    for k in range(2):
        expected = platt(logit[:, k], np.array([kinds >> k & 1 for _, kinds in aside]))
        assert np.allclose([model.slope[k], model.offset[k], model.threshold[k]], expected, rtol=1e-6)
    rng = random.Random(9)
    hidden = [f'pwd "{noise(rng, 40).upper()}" lorem' for _ in range(50)]
    clean = [f"lorem card {noise(rng, 16, '0123456789')} and 555-{noise(rng, 4, '0123456789')} mail7.example.com sit" for _ in range(50)]
    found = secrets.scan(spark.createDataFrame(list(enumerate([*hidden, *clean])), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert sum(len(r["spans"]) for r in found[:50]) >= 45 and not any(r["spans"] for r in found[50:])


def test_rare_windows_are_in_several_parts(spark):
    """Each part has all of the few labelled windows; other windows are in one part each."""
    rows = [(f"{i}".rjust(secrets.WIDTH, "x"), 1 << i % 3 if i < 30 else 0, i % 10 == 9) for i in range(3000)]
    found = spark.createDataFrame(rows, "window string, kinds int, aside boolean")
    counts = Counter((a, k) for _, k, a in rows)
    parts = secrets._dealt(found, counts, 4).collect()
    labels = [np.frombuffer(r["y"], np.uint8) for r in parts]
    assert len(parts) == 4 and all((y > 0).sum() == 4 * sum(n for (a, k), n in counts.items() if k and not a) for y in labels)
    assert sum((y == 0).sum() for y in labels) == counts[False, 0] and sum(len(r["aside_y"]) for r in parts) == 300


def test_digests_of_findings(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(None, "AKIA" + "Q" * 20), (1, TRICKY[1])]
    found = secrets.digests(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), None)).collect()
    expected = Counter()
    for i, t in rows:
        spans = brute_findings(t)
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        expected[(i, text, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["spans"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found) == expected


def test_scan_of_nothing_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.secret_scan(none).count() == 0
    plain = spark.createDataFrame([(1, "nothing 12345678 here"), (2, None)], "doc_id long, text string")
    assert [r["spans"] for r in secrets.secret_scan(plain).collect()] == [[], []]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = secrets.Network(1)
    net.p = {n: v.astype(np.float64) for n, v in net.p.items()}
    x, y = rng.integers(0, 97, (6, secrets.WIDTH)).astype(np.uint8), rng.integers(0, 2, (6, 3)).astype(float)
    weigh = rng.random((6, 3))

    def loss():
        z = net.logits(x)
        return float((weigh * (np.logaddexp(0, z) - y * z)).sum() / len(x))

    g = net.gradients(x, y, weigh)
    for name, value in net.p.items():
        flat = value.reshape(-1)
        for at in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old, step = flat[at], 1e-6
            flat[at] = old + step
            up = loss()
            flat[at] = old - step
            down = loss()
            flat[at] = old
            assert abs((up - down) / (2 * step) - g[name].reshape(-1)[at]) < 1e-4, name
