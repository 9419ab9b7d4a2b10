import json
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from genospark.llm import language_id, packing, token_files, tokens
from genospark.llm.mixing import mix
from genospark.llm.tokens import PieceTokenizer

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PIECES = {n: PieceTokenizer(open(public_tokenizers.path(n)).read()) for n in NAMES}
PLAIN = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES}
alphabet = st.sampled_from(["a", "B", "é", "ß", "1", ".", "'s", " ", "  ", "\n", "\t", "\r\n", "\x00", "\x1c", "\x85", "\xa0", " ", "　", "́", "Σ", "<|endoftext|>", "<|", "#", "漢", "🙂", "a,", "n't", "e-", "\u2003", "\u200b", "½"])


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(parts=st.lists(alphabet, max_size=30))
def test_pieces_give_the_tokenizers_own_ids(name, parts):
    texts = ["".join(parts), None, "".join(parts[::2]), ""]
    ids, bounds = PIECES[name].encode(pa.array(texts, pa.string()), 2)
    for text, own in zip(texts, np.split(ids, bounds[1:-1]), strict=True):
        assert own.tolist() == [*PLAIN[name].encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.integers(0, 99), max_size=400), lanes=st.integers(1, 9))
def test_coder_round_trip(ids, lanes):
    ids = np.array(ids, np.int64)
    assert token_files.decode_ids(token_files.encode_ids(ids, 100, lanes), len(ids), 100, lanes).tolist() == ids.tolist()


@pytest.mark.parametrize("source", ["uniform", "same", "pairs", "skewed"])
def test_coder_round_trip_of_large_blocks(source):
    rng = np.random.default_rng(3)
    n, vocabulary = 60_000, 49_408
    ids = {"uniform": rng.integers(0, vocabulary, n), "same": np.full(n, vocabulary - 1), "pairs": np.arange(n) % 7, "skewed": np.minimum(rng.geometric(0.01, n), vocabulary - 1)}[source]
    data = token_files.encode_ids(ids, vocabulary)
    assert (token_files.decode_ids(data, n, vocabulary) == ids).all()
    if source in ("same", "pairs"):
        assert len(data) < n // 2


@pytest.mark.parametrize("n", [700_001, 2_200_000, 5_000_000])
def test_coder_round_trip_of_a_very_long_document(n):
    vocabulary = 49_408
    ids = np.minimum(np.random.default_rng(5).geometric(0.002, n) - 1, vocabulary - 1)
    back = token_files.read_block(token_files.write_block(token_files.Block(3, 17, [None], np.array([n]), ids), vocabulary))
    assert (back.part, back.start, back.doc_ids, back.lengths.tolist()) == (3, 17, [None], [n]) and (back.ids == ids).all()


def test_contexts_shorten_the_code():
    # Order 0 alone needs 8 bits an id; what follows each id, or each pair of ids, is nearly certain.
    rng = np.random.default_rng(9)
    n = 1 << 20
    ids = rng.integers(0, 256, n)
    one = np.zeros(n, np.int64)
    for i in range(1, n):
        one[i] = (one[i - 1] * 7 + 3) % 256 if ids[i] < 230 else ids[i]
    assert len(token_files.encode_ids(one, 256)) < n // 3 < len(token_files.encode_ids(ids, 256))


def test_blocks_are_checked():
    held = token_files.Block(1, 5, [7, None], np.array([2, 3]), np.array([5, 6, 7, 8, 9]))
    block = token_files.write_block(held, 10)
    back = token_files.read_block(block)
    assert (back.doc_ids, back.lengths.tolist(), back.ids.tolist()) == ([7, None], [2, 3], [5, 6, 7, 8, 9])
    for at in range(len(block)):
        broken = bytearray(block)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            token_files.read_block(bytes(broken))


ROWS = [(0, "Hello there\nfriend"), (1, None), (2, ""), (3, "word " * 3000), (4, "a  b"), (4, "a  b"), (4, "other"), (None, "no id"), (9, "x" * 500)]


def test_token_files_equal_plain_encoding(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    docs = spark.createDataFrame([(*r, 7) for r in ROWS], "doc_id long, text string, payload int")
    blocks = token_files.write_token_files(docs, public_tokenizers.path(NAMES[1]))
    found = token_files.read_token_files(blocks).collect()
    assert blocks.count() > 1 and len(found) == len(ROWS)
    ids = defaultdict(list)
    for i, t in ROWS:
        ids[i].append([*PLAIN[NAMES[1]].encode(t or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at and r["ids"] in ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == [None, 0, 1, 2, 3, 4, 4, 4, 9]


def test_packing_is_whole_gapless_and_tight(spark):
    rows = ROWS + [(100 + i, "tok " * (i * 37 % 900)) for i in range(300)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, salt string, length int")
    out = packing.pack(docs, public_tokenizers.path(NAMES[0])).collect()
    lengths = [len(PLAIN[NAMES[0]].encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    assert sum(r["length"] for r in out) == sum(lengths)
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r["sequence_id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(lengths) // 1024) + 2
    long = sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == 3)
    total = next(n for (i, _), n in zip(rows, lengths, strict=True) if i == 3)
    assert [x[2] for x in long] == [total % 1024, *[1024] * (total // 1024)] and [x[1] for x in long] == np.cumsum([0, *[x[2] for x in long[:-1]]]).tolist()
    assert Counter(r["doc_id"] for r in out)[4] == 3


def test_packing_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, public_tokenizers.path(NAMES[0])).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(docs, public_tokenizers.path(NAMES[1]))).count() == 0


@settings(max_examples=80, deadline=None)
@given(lengths=st.lists(st.integers(1, 64), max_size=120))
def test_plan_holds_each_length_as_often_as_it_occurs(lengths):
    histogram = np.bincount(lengths, minlength=65)[:65] if lengths else np.zeros(65, int)
    blocks = packing.plan(histogram, 64)
    held = np.zeros(65, int)
    for pattern, repeats in blocks:
        assert sum(pattern) <= 64
        np.add.at(held, pattern, repeats)
    assert (held == histogram).all()
    table = packing.places(blocks)
    assert len(table["length"]) == sum(len(p) for p, _ in blocks)


def test_pattern_fit_finds_a_packing_without_waste():
    # Halves and thirds that fit exactly: the fit must find the perfect packing.
    histogram = np.zeros(1025, int)
    histogram[[1000, 24, 512, 300, 424]] = [500, 500, 200, 200, 100]
    sequences = sum(n for _, n in packing.plan(histogram, 1024))
    assert sequences <= -(-int((histogram * np.arange(1025)).sum()) // 1024) + 2


def brute_targets(sizes, share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing_meets_its_targets(spark):
    sizes = {"a": 900, "b": 40, "é": 300, "z": 200, None: 120, "none": 0}
    rows, i = [], 0
    for source, docs in sizes.items():
        for k in range(docs):
            rows.append((i, "w " * (k % 9) + ("#### " if k % 5 == 0 else ""), source, 1, "x"))
            i += 1
    rows += [(i, None, "none", 1, "x"), (i + 1, "", "none", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copies string")
    first, again = mix(docs).collect(), mix(docs.repartition(7)).collect()
    assert {r["doc_id"]: r["taken"] for r in first} == {r["doc_id"]: r["taken"] for r in again}
    words = {d[0]: len((d[1] or "").split()) for d in rows}
    by_source = defaultdict(int)
    for d in rows:
        by_source[d[2]] += words[d[0]]
    target = brute_targets(dict(by_source))
    taken = defaultdict(int)
    for r in first:
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == by_source[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 2 * r["size"]
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] in (r["epochs"], r["epochs"] + 1)
        taken[r["source"]] += r["taken"]
    for source, want in target.items():
        assert abs(taken[source] - want) <= 9
    assert mix(docs.where("false")).count() == 0


def test_mixing_prefers_heavier_documents(spark):
    rows = [(i, "abc " * 10, "a", 1.0 if i % 2 else 0.25) for i in range(4000)] + [(9000, "z", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    out = mix(docs, budget_share=0.5, max_epochs=1.0, weight_col="weight").where("source = 'a'").toPandas()
    assert (out["epochs"] == 0).all() and abs(out["taken"].sum() - out["target"].iloc[0]) <= 10
    heavy, light = (int((out["taken"] > 0)[out["doc_id"] % 2 == k].sum()) for k in (1, 0))
    # P(key < t) is 1 - exp(-weight t): with half of all taken, a heavy one is taken 2.7 times as often as a light one.
    assert light > 300 and 2.3 < heavy / light < 3.2


def test_mixing_takes_sizes_that_are_given(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7), "s", i % 7) for i in range(500)], "doc_id long, text string, source string, n int")
    one, two = (mix(docs, size_col=c).select("doc_id", "size", "taken").orderBy("doc_id").collect() for c in (None, "n"))
    assert one == two


def test_fit_is_the_non_negative_least_squares():
    rng = np.random.default_rng(11)
    for capacity, slack in ((40, 0), (40, 3), (25, 6)):
        histogram = np.zeros(capacity + 1, int)
        histogram[1:] = rng.integers(0, 9, capacity) * (rng.random(capacity) < 0.7)
        size, times = packing.enumerate_patterns(np.flatnonzero(histogram[1:]) + 1, capacity, slack)
        fill = (size * times).sum(1)
        assert ((fill <= capacity) & (fill >= capacity - slack)).all()
        assert len({tuple(sorted(zip(s, t, strict=True))) for s, t in zip(size.tolist(), times.tolist(), strict=True)}) == len(size)
        free, x, violation = packing.fit_counts(size, times, histogram)
        a = np.zeros((capacity + 1, len(size)))
        for c in range(3):
            np.add.at(a, (size[:, c], np.arange(len(size))), times[:, c])
        a[0] = 0
        # Projected gradient, run long, is the reference.
        z, step = np.zeros(len(size)), 1 / np.linalg.norm(a, 2) ** 2
        for _ in range(60_000):
            z = np.maximum(0, z - step * (a.T @ (a @ z - histogram)))
        full = np.zeros(len(size))
        full[free] = x
        assert violation <= packing.FIT_TOLERANCE and (x > 0).all()
        assert np.linalg.norm(a @ full - histogram) <= np.linalg.norm(a @ z - histogram) + 1e-2


def test_patterns_place_short_documents_alone():
    histogram = np.zeros(1025, int)
    histogram[5:200] = np.random.default_rng(0).integers(0, 50, 195)
    sequences = sum(n for _, n in packing.plan(histogram, 1024))
    assert sequences <= -(-int((histogram * np.arange(1025)).sum()) // 1024) + 1


def test_packed_pieces_have_the_ids_of_plain_encoding(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "One  two\nthree", "tok, " * 1500, "x" * 9000, "éß… " * 700, "same", "same"])]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path(NAMES[0])).collect()
    found = defaultdict(list)
    for r in out:
        found[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in rows:
        ids = [*PLAIN[NAMES[0]].encode(t or "", add_special_tokens=False).ids, 2]
        at, expected = 0, []
        while at < len(ids):
            n = ((len(ids) - 1) % 1024 + 1) if at == 0 else 1024
            expected.append((len(expected), at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
        assert sorted(found[i]) == expected


def test_a_guess_that_never_came_true_keeps_a_slot():
    mixer = token_files.Mixer(100, 4, decodes=False)
    mixer.seen[:, 0] = 1e12  # as after very many misses
    mixer._weigh()
    assert mixer.weight_a.min() == mixer.weight_b.min() == 1
    mixer.seen[:, 1] = mixer.seen[:, 0] - 1
    mixer._weigh()
    # Order 0 keeps its slots beside the most that order 1's parts add up to.
    assert (mixer.weight_a + mixer.weight_b).max() + (1 << token_files.SCALE_BITS) + 100 <= token_files._TOTAL - (1 << token_files.ZERO_BITS)


def test_order_1_counts_what_followed_each_id():
    rng = np.random.default_rng(4)
    mixer = token_files.Mixer(50, 16, decodes=False)
    steps = [np.minimum(rng.geometric(0.1, 16), 49).astype(np.int32) for _ in range(40)]
    for ids in steps:
        mixer.look()
        mixer.learn(ids, np.zeros(16, np.int64))
    mixer._count_pairs()
    plain = Counter((a, b) for x, y in zip([np.full(16, 50), *steps], steps) for a, b in zip(x.tolist(), y.tolist()))
    assert dict(zip(mixer.pairs.tolist(), mixer.times.tolist())) == {a * 50 + b: n for (a, b), n in plain.items()}
    for a in range(51):
        assert mixer.total1[a] == sum(n for (x, _), n in plain.items() if x == a)
    place, there = mixer.places(np.arange(16, dtype=np.int32))
    for last, i, at, known in zip(mixer.last.tolist(), range(16), place, there):
        assert known == ((last, i) in plain) and (not known or mixer.pairs[at] == last * 50 + i)


def test_counts_of_order_1_are_scaled_and_pairs_that_share_a_slot_are_found(monkeypatch):
    monkeypatch.setattr(token_files, "SCALE_BITS", 4)
    monkeypatch.setattr(token_files, "PLACE_BITS", 3)
    rng = np.random.default_rng(8)
    for ids in (np.minimum(rng.geometric(0.05, 50_000), 199), np.arange(50_000) % 3):
        assert (token_files.decode_ids(token_files.encode_ids(ids, 200), len(ids), 200) == ids).all()


def test_followers_of_equal_chance_cost_their_logarithm():
    # Eight followers of each of 4,096 ids, equally likely: 3 bits of 12; no single guess is right more than 1 in 8 times.
    rng = np.random.default_rng(10)
    n = 1 << 20
    choice = rng.integers(0, 8, n)
    ids = np.zeros(n, np.int64)
    for i in range(1, n):
        ids[i] = (ids[i - 1] * 5 + 1 + choice[i] * 511) % 4096
    assert 8 * len(token_files.encode_ids(ids, 4096)) < 4.2 * n


def test_plain_words_are_tokenized_together_and_other_pieces_on_their_own():
    tokenizer = PieceTokenizer(open(public_tokenizers.path(NAMES[1])).read())
    letters = [chr(x) for x in range(0x180) if chr(x).isalpha()]
    plain = [c for c in letters if c != "\u0130"]
    texts = [f"{c} x{c}y\n{c}{c}Z {c}" for c in letters] + ["It's nine o'clock; don't 12 a\u0301\u0300 H\u0331 \u03a3\u03a3 \u4e2d"]
    alone, tokenize = [], tokenizer._tokenize
    tokenizer._tokenize = lambda pieces, together: (None if together else alone.extend(pieces), tokenize(pieces, together))[1]
    ids, bounds = tokenizer.encode(pa.array(texts))
    for text, own in zip(texts, np.split(ids, bounds[1:-1]), strict=True):
        assert own.tolist() == PLAIN[NAMES[1]].encode(text, add_special_tokens=False).ids
    assert not any(p.decode().strip() in plain for p in alone) and {"'s", "\u0130"} <= {p.decode().strip() for p in alone}
    assert PIECES[NAMES[0]].words is None


def test_words_without_an_end_in_the_vocabulary_are_tokenized_on_their_own():
    spec = json.loads(open(public_tokenizers.path(NAMES[1])).read())
    spec["model"]["vocab"] = {t: i for t, i in spec["model"]["vocab"].items() if t not in ("z</w>",)}
    spec["model"]["merges"] = [m for m in spec["model"]["merges"] if "z</w>" not in (m if isinstance(m, list) else m.split())]
    ids, bounds = PieceTokenizer(json.dumps(spec)).encode(pa.array(["jazz band", "z", "a z b"]))
    whole = Tokenizer.from_str(json.dumps(spec))
    for text, own in zip(["jazz band", "z", "a z b"], np.split(ids, bounds[1:-1]), strict=True):
        assert own.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_end_before_marks_that_follow_letters_of_latin_1():
    texts = [f"x{chr(c)}{mark} {chr(c)}{mark}s{mark}{mark}" for c in range(0xA0, 0x180) for mark in ",'<-"]
    for name in NAMES:
        ids, bounds = PIECES[name].encode(pa.array(texts))
        for text, own in zip(texts, np.split(ids, bounds[1:-1]), strict=True):
            assert own.tolist() == PLAIN[name].encode(text, add_special_tokens=False).ids
    assert b" dor\xc3\xa9" in tokens._pieces(pa.array([" doré, dor×,"], pa.large_string()))[0].dictionary.to_pylist()


def test_blocks_of_version_4_keep_their_bytes():
    x = np.arange(300_000)
    for ids, vocabulary, crc in (((x * x // 7) % 3001 % (1 + x % 97 * 31), 3001, 1963208351), ((x % 5000) ** 3 % 60_013 % (1 + x // 100), 70_000, 2257570665)):
        data = token_files.encode_ids(ids, vocabulary)
        assert zlib.crc32(data) == crc and (token_files.decode_ids(data, len(ids), vocabulary) == ids).all()


def test_a_worker_drops_what_other_operators_left(spark):
    """Tokens of texts outlive a task of their own operators, but not the start of another one's."""
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        spec = f.read()
    own = PieceTokenizer.get(spec)
    assert PieceTokenizer.get(spec) is own
    left = weakref.ref(own)
    del own
    no_rows = pa.record_batch([pa.array([], pa.string())] * 2, names=["text", "lang"])
    docs = Recorded()
    language_id._counts(docs)
    assert left() is not None
    list(docs.task(iter([no_rows])))
    assert left() is None


@pytest.mark.parametrize("name", NAMES)
def test_pieces_that_recur_are_remembered_within_bounds(name):
    tokenizer = PieceTokenizer(open(public_tokenizers.path(name)).read(), 1 << 20)
    common, largest = [f" tomorrow{i}" for i in range(100)], 0
    for call in range(12):
        rare = [f" {call}x{i}y" for i in range(2000)]
        text = "".join(common + rare) + " Once, é-again"
        lost = set(common) - {p.decode() for p in tokenizer.number}
        assert not call or not lost
        ids, _ = tokenizer.encode(pa.array([text, None]))
        assert ids.tolist() == PLAIN[name].encode(text, add_special_tokens=False).ids
        assert len(tokenizer.number) * tokens._ENTRY < tokenizer.bytes
        largest = max(largest, tokenizer.bytes)
    assert 1 << 20 < largest < 2 << 20


def test_packing_bounds_its_workers_and_stores_one_table(spark, monkeypatch):
    names, stored, slices = [], packing.stored, []
    monkeypatch.setattr(packing, "stored", lambda df, name: (names.append(name), stored(df, name))[1])
    docs = spark.createDataFrame([(i, "tok " * (i % 7)) for i in range(40)], "doc_id long, text string")
    out = packing.pack(docs, public_tokenizers.path(NAMES[0])).collect()
    assert names == ["pack-pieces"] and len(out) == len({(r["sequence_id"], r["offset"]) for r in out}) == 40
    recorded, encode = Recorded(), PieceTokenizer.encode
    recorded.sparkSession = spark
    monkeypatch.setattr(PieceTokenizer, "encode", lambda self, texts, end: (slices.append((self.most, texts.nbytes)), encode(self, texts, end))[1])
    packing.token_pieces(recorded, public_tokenizers.path(NAMES[0]))
    batch = pa.record_batch([pa.array(range(200)), pa.array(["tok " * 15_000] * 200)], names=["doc_id", "text"])
    length = len(PLAIN[NAMES[0]].encode("tok " * 15_000, add_special_tokens=False).ids) + 1
    assert sum(b.num_rows for b in recorded.task(iter([batch]))) == 200 * -(-length // 1024)
    assert {most for most, _ in slices} == {packing.REMEMBERED} and max(n for _, n in slices) < 5 << 20 and packing.REMEMBERED <= 64 << 20


class Recorded:
    """Stands for a DataFrame; keeps the function that its tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, task, schema):
        self.task = task
        return self

    groupBy = agg = select
