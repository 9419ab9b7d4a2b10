import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import whole_tree

from genospark.llm import language_id, lm_scoring, quality_rules, quality_trees
from genospark.llm.quality_rules import Words, measures, repeated_words


def crc(i):
    return zlib.crc32(str(i).encode())


LETTERS = {"aa": "abc", "bb": "cde", "cc": "xyz"}


def word(rng, letters):
    return "".join(letters[rng.integers(len(letters))] for _ in range(rng.integers(2, 7)))


def labelled(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(LETTERS)[i % 3]
        out.append((i, " ".join(word(rng, LETTERS[lang]) for _ in range(12)), lang))
    return out


def test_language_id_held_out_and_edges(spark):
    rows = labelled(240)
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (1004, "½ ² Ⅷ 2½ ①", "bb"), (1003, "xyzzy " * 20_000, None), (None, "abcab", None), (1003, "xyzzy", None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows + extra], "doc_id long, text string, lang string, score int, lang_pred string")
    out = language_id.identify(docs).collect()
    assert len(out) == len(rows) + len(extra)
    found = {(r["doc_id"], r["text"]): r for r in out}
    for i, text, lang in rows:
        r = found[i, text]
        assert r["held_out"] == (crc(i) % 4 == 2) and 0 <= r["score"] <= 1
        if r["held_out"]:
            assert r["lang_pred"] == lang
    for i, text, _ in extra[:4]:
        assert (found[i, text]["lang_pred"], found[i, text]["score"]) == ("und", 0.0)
    assert found[1003, "xyzzy"]["lang_pred"] == "cc" and found[1003, "xyzzy " * 20_000]["lang_pred"] == "cc"
    assert found[None, "abcab"]["lang_pred"] in ("aa", "bb")


def test_language_id_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(docs).first()["lang_pred"] == "und"
    assert language_id.identify(docs.where("false")).count() == 0


def test_words_are_runs_of_letters():
    assert language_id.words_of("Ab½c aⅧB x² x\u0301y ñÑ 3rd_go") == {"ab": 1, "c": 1, "a": 1, "b": 1, "x": 2, "y": 1, "ññ": 1, "rd": 1, "go": 1}


def test_backoff_uses_the_longest_known_order():
    model = language_id.Model(["a", "b"], {"known": 0}, np.array([[0.0, -9.0]]), {"<qx": 0, "q": 1}, np.array([[-9.0, 0.0], [0.0, -9.0]]))
    scorer = language_id.Scorer(model)
    assert scorer.score("known")[0] == "a"
    assert scorer.score("qxy")[0] == "b"  # by the trigram, not the letter
    assert scorer.score("aqa")[0] == "a"  # only the letter is known


def quality_rows(n):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(n):
        words = [word(rng, "abcdefgh") for _ in range(60)]
        good = i % 3 > 0
        docs.append((i, " ".join(words) + "." if good else " ".join(w + "###" for w in words), "x"))
        labels.append((i, int(good), 0))
    return docs, labels


@pytest.fixture(scope="module")
def quality(spark):
    docs, labels = quality_rows(240)
    edges = [(900, None, "x"), (901, "", "x"), (902, "z " * 50_000, "x"), (902, "z " * 50_000, "x"), (None, "plain words here", "x")]
    return (
        spark.createDataFrame(docs + edges, "doc_id long, text string, score string"),
        spark.createDataFrame(labels + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"),
        {d[0]: d[1] for d in docs}, {d[0]: d[1] for d in labels},
    )


def test_quality_trees_on_held_out_rows(spark, quality):
    docs, labels, _, truth = quality
    out = quality_trees.classify(docs, labels).collect()
    assert len(out) == 245
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["doc_id"] in truth:
            assert r["held_out"] == (crc(r["doc_id"]) % 4 == 2)
            assert r["predicted"] == truth[r["doc_id"]]
    assert quality_trees.classify(docs, labels.where("false")).count() == 245
    assert quality_trees.classify(docs.where("false"), labels).count() == 0


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = quality_trees.boost(x, y, trees=15, depth=3)
    for row, odds in zip(x[:50], trees.log_odds(x[:50]), strict=True):
        total = trees.prior
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert odds == pytest.approx(total)
    assert ((trees.log_odds(x) > 0) == (y > 0)).mean() > 0.9


def brute_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("seed", range(40))
def test_measures_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    parts = ["a", "b", "é#", "c\xa0d", "<>", "漢"][: 1 + seed % 6]
    text = "".join(parts[rng.integers(len(parts))] + " \n\t\r"[rng.integers(4)] * int(rng.integers(1, 3)) for _ in range(int(rng.integers(0, 200))))
    raw, words = text.encode(), Words()
    assert measures(raw, words.ids(raw.split())) == brute_measures(text)


def test_repeated_words_edges():
    assert [repeated_words(np.arange(n)) for n in (0, 7, 8, 9)] == [0, 0, 0, 0]
    assert repeated_words(np.zeros(9, np.int64)) == 9
    assert repeated_words(np.tile(np.arange(10), 2)) == 20


def test_quality_rules(spark, quality):
    docs, labels, texts, truth = quality
    out = quality_rules.judge(docs, labels).collect()
    assert len(out) == 245
    for r in out:
        if r["doc_id"] in texts:
            found = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
            assert found == brute_measures(texts[r["doc_id"]])
            if crc(r["doc_id"]) % 4 == 2:
                assert r["kept"] == bool(truth[r["doc_id"]])
        if r["doc_id"] in (900, 901):
            assert r["n_words"] == 0 and r["base_failed"] and not r["kept"]
    assert quality_rules.judge(docs, labels.where("false")).count() == 245
    assert quality_rules.judge(docs.where("false"), labels).count() == 0


def test_words_keep_their_hashes_when_the_table_grows():
    words = Words()
    many = [str(i).encode() for i in range(70_000)]
    ids = words.ids(many)
    assert words.hashes[ids[[0, 69_999]]].tolist() == [zlib.crc32(b"0"), zlib.crc32(b"69999")]


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def brute_tree(texts, depth):
    """Context-tree weighting by its recursion, one bit node at a time: log2 is not needed, natural logs."""
    counts = {}
    for t in texts:
        data = bytes(depth) + t + b"\xff"
        for i in range(depth, len(data)):
            node = 1
            for bit in range(7, -1, -1):
                b = data[i] >> bit & 1
                for d in range(depth + 1):
                    counts.setdefault((data[i - d : i], node), [0, 0])[b] += 1
                node = node * 2 + b
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[1:], node), []).append(context)

    def weighted(context, node):
        own = log_kt(*counts[context, node])
        if len(context) == depth:
            return own, own, 0.0
        below = sum(weighted(c, node)[0] for c in children.get((context, node), []))
        return np.logaddexp(own, below) - math.log(2), own, below

    def one(data, i, d, node):
        context = data[i - d : i]
        a, b = counts.get((context, node), (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if d == depth:
            return estimate
        if a + b == 0:
            return 0.5
        _, own, below = weighted(context, node)
        share = 1 / (1 + math.exp(below - own))
        return share * estimate + (1 - share) * one(data, i, d + 1, node)

    def score(t):
        data, total = bytes(depth) + t + b"\xff", 0.0
        for i in range(depth, len(data)):
            node = 1
            for bit in range(7, -1, -1):
                b = data[i] >> bit & 1
                p = one(data, i, 0, node)
                total += math.log(p if b else 1 - p)
                node = node * 2 + b
        return total

    return score


def test_tree_equals_the_recursion(spark):
    texts = [b"abracadabra", b"abra cad", b"", b"zz top"]
    df = spark.createDataFrame([(t,) for t in texts], "raw binary")
    tree = whole_tree.fit_tree(df)
    score = brute_tree(texts, lm_scoring.DEPTH)
    probes = [*texts, b"abrac", b"q", b"cadab top", "é".encode()]
    assert tree.log_probability(probes) == pytest.approx([score(t) for t in probes], rel=1e-4)


def test_tree_with_few_contexts_is_still_a_distribution(spark):
    df = spark.createDataFrame([(b"the cat sat on the mat " * 3,), (b"a dog",)], "raw binary")
    tree = whole_tree.fit_tree(df, max_contexts=6)
    assert np.exp(tree.logs.astype(float)).sum(1) == pytest.approx(1, abs=1e-4)
    assert np.isfinite(tree.log_probability([b"the", b"unseen \xc3\xa9", b""])).all()


@pytest.mark.parametrize("hot", [0, 9, 1 << 20])
def test_scores_equal_the_recursion(spark, monkeypatch, hot):
    monkeypatch.setattr(lm_scoring, "HOT_PAIRS", hot)
    texts = [b"abracadabra", b"abra cad", b"", b"zz top"]
    probes = [*texts, b"abrac", b"q", b"cadab top", "é".encode()]
    table = lambda rows: spark.createDataFrame([(i, t.decode()) for i, t in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in lm_scoring.lm_score(table([*probes, b"q"]), table(texts)).collect()}
    score = brute_tree(texts, lm_scoring.DEPTH)
    assert [found[i] for i in range(9)] == pytest.approx([score(t) / math.log(10) for t in [*probes, b"q"]], rel=1e-5)


def test_scores_use_every_context(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(4000)]
    texts = [" ".join(rng.permutation(words)[:n]) for n in (4000, 4000, 2000, 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in lm_scoring.lm_score(docs, docs.where("doc_id < 3")).collect()}
    tree = whole_tree.fit_tree(spark.createDataFrame([(t.encode(),) for t in texts[:3]], "raw binary"), max_contexts=1 << 30)
    assert len(tree.logs) > 1 << 15
    whole = tree.log_probability([t.encode() for t in texts]) / math.log(10)
    assert [found[i] for i in range(4)] == pytest.approx(whole, rel=1e-5)


def test_pair_table_finds_what_it_holds():
    pairs = np.random.default_rng(1).permutation(1 << 16)[:30_000].astype(np.uint64)
    logs, lacking = lm_scoring.PairTable(pairs[:20_000], np.arange(20_000, dtype=np.float32)).look(pairs)
    assert (logs[:20_000] == np.arange(20_000)).all() and (logs[20_000:] == 0).all()
    assert lacking.tolist() == list(range(20_000, 30_000))


def test_lm_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT_WORDS", 2)
    rows = [(i, " ".join(["The", "cat", f"w{i % 5}", f"only{i}"][: i % 5])) for i in range(40)] + [(100, None), (101, "NEW thing\nthe"), (101, "NEW thing\nthe"), (None, "The cat")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, word int, score string")
    out = lm_scoring.score_held_out(docs).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
    counts = Counter(w for i, t in rows if i is None or crc(i) % 7 != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        own = tokens(texts[r["doc_id"]])
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"]) % 7 == 2) and r["score"] < 0
    assert lm_scoring.score_held_out(docs.where("false")).count() == 0


def test_long_texts_are_scored_in_segments(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT_PAIRS", 20)
    rows = [(i, f"the cat sat {i} on the Mat\n" * i) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: (r["n_tokens"], r["base_score"], r["score"]) for r in lm_scoring.score_held_out(docs).collect()}
    for size in (6, 7, 64):
        lows = [t.lower().encode() for _, t in rows]
        monkeypatch.setattr(lm_scoring, "SEGMENT", size)
        parts = [np.concatenate(c) for c in zip(*lm_scoring._segments(lows), strict=True)]
        assert (parts[0] == lm_scoring._contexts(*lm_scoring._codes(lows))).all()
        assert (parts[1] == np.repeat(np.arange(9), [len(t) + 1 for t in lows])).all()
    code, at = zip(*lm_scoring._segments([b"", b"x" * 100]), strict=True)
    assert len(code) > 1 and np.concatenate(at).tolist() == [0] + [1] * 101
    assert whole[0][0] == 1 and whole[8][2] < whole[1][2] < 0
