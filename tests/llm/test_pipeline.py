"""The pipeline's stages on a small corpus, each against what its own input asks for."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from genospark.llm import queries as llm_queries

LETTERS = {"en": "thandoringes", "fr": "leuxmontrépa"}


def text(lang, seed, words=60):
    """Words that two seeds hardly share."""
    letters, out = LETTERS[lang], []
    for k in range(words):
        x = (seed * 7919 + k * 104729 + 17) * 2654435761 % 2**32
        out.append("".join(letters[(x >> (3 * j)) % len(letters)] for j in range(2 + x % 6)))
    return " ".join(out)


COMMON = "this line stands in many documents"


def rows():
    out = []
    for i in range(120):
        lang = "en" if i % 2 else "fr"
        body = text(lang, i)
        out.append((i, f"{COMMON}\n{body}" if i < 15 else body, lang, f"s{i % 4}", 1))
    near = text("en", 999, 100).split()
    for k in range(5):
        own = list(near)
        own[k * 7] = f"changed{k}"
        out.append((200 + k, " ".join(own), "en", "s0", 1))
    out += [(300, None, "en", "s1", 0), (301, "123 456 !!", None, None, 1), (302, "", "fr", "s2", 0)]
    out += [(303 + k, COMMON, "en", "s1", 1) for k in range(3)]
    out += [(None, text("fr", 5000), None, None, 1)]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 120, 2)] + [(5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    out = {"input": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema if name != "packing" else None)
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    return out


def test_language_stage_rejects_only_what_has_no_letters(stages):
    gone = {r["doc_id"] for r in stages["input"]} - {r["doc_id"] for r in stages["language_id"]}
    assert gone == {300, 301, 302}
    assert all(r["lang"] for r in stages["language_id"])


def test_line_stage_keeps_first_places(stages):
    before = {r["doc_id"]: r["text"] for r in stages["language_id"]}
    after = {r["doc_id"]: r["text"] for r in stages["line_dedup"]}
    where = defaultdict(set)
    for i, t in before.items():
        for line in t.split("\n"):
            where[line.strip().lower()].add(-1 if i is None else i)
    for i, t in before.items():
        kept = [x for x in t.split("\n") if len(where[x.strip().lower()]) < 10 or min(where[x.strip().lower()]) == (-1 if i is None else i)]
        if kept:
            assert after[i] == "\n".join(kept)
        else:
            assert i not in after
    assert after[0].startswith(COMMON) and not after[1].startswith(COMMON) and 303 not in after


def test_join_stage_keeps_one_of_each_group(stages):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}

    before = {r["doc_id"]: grams(r["text"]) for r in stages["line_dedup"]}
    kept = Counter(r["doc_id"] for r in stages["ngram_join"])
    assert set(kept.values()) == {1} and None in kept
    ids = [i for i in before if i is not None]
    for i in ids:
        linked = [j for j in ids if j < i and len(before[i] & before[j]) * 100 >= 80 * len(before[i] | before[j])]
        assert (i in kept) == (not linked), i


def test_mixing_stage_repeats_documents(stages):
    before = {r["doc_id"]: r for r in stages["ngram_join"]}
    taken = Counter(r["doc_id"] for r in stages["mixing"])
    assert max(taken.values()) <= 2 and set(taken) <= set(before)
    words = sum(len(r["text"].split()) for r in stages["mixing"])
    whole = sum(len(r["text"].split()) for r in before.values())
    assert abs(words - 1.5 * whole) <= 60 * len({r["source"] for r in before.values()})


def test_packing_stage_holds_every_copy(stages):
    pieces = Counter(r["doc_id"] for r in stages["packing"] if r["piece"] == 0)
    assert pieces == Counter(r["doc_id"] for r in stages["mixing"])
    fill = defaultdict(int)
    for r in stages["packing"]:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 1


def test_packing_stage_has_the_ids_of_plain_encoding(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2] for r in stages["mixing"]}
    for r in stages["packing"]:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]


def test_run_gives_what_its_stages_give_one_after_the_other(spark, sf_dir, stages):
    """``run`` reads documents, and each stage's rows as its predecessor wrote them."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, "more") for r in rows()], f"{schema}, extra string").write.parquet(f"{sf_dir}/documents.parquet")
    found = corpus_pipeline.run(spark, sf_dir)
    names = [c for c in found.columns if c not in ("sequence_id", "offset")]
    count = lambda got: Counter(tuple(r[c] for c in names) for r in got)
    got = found.collect()
    assert count(got) == count(stages["packing"])
    # Sequences are gapless, and as many as in the stage by itself.
    ends = defaultdict(list)
    for r in got:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    assert len(ends) == len({r["sequence_id"] for r in stages["packing"]})


def test_stages_of_nothing(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_registry_names_every_operator():
    numbers = sorted(int(m[1]) for n in llm_queries.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14))
    assert set(llm_queries.oracle_sql()) <= set(llm_queries.queries())
