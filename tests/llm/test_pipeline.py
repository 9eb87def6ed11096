"""The pipeline stage by stage on a small scale factor, against brute force."""

import re
import warnings

import corpus_pipeline
import pytest

from quillnest.llm import mixing, quality
from quillnest.llm.common import Scratch, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """For each stage but the last its input, its output and what it returned."""
    scratch, docs, out = Scratch(spark), table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            done = scratch.keep(stage(spark, docs, sf_dir))
        out[name] = ({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in done.collect()}, docs, done)
        docs = done
    return out


def test_columns_and_whole_chain(spark, sf_dir, stages):
    columns = table(spark, sf_dir, "documents").columns
    for name, (before, after, _, done) in stages.items():
        assert set(after) <= set(before) and done.count() == len(after), name
        assert all(after[i].text == before[i] for i in after), name
    assert stages["benchmark_decontamination"][3].columns == columns


def test_quality_stage(spark, sf_dir, stages):
    before, after, docs, _ = stages["quality_classifier"]
    labels = {r.doc_id: r for r in table(spark, sf_dir, "labels").collect()}
    good = [i for i in before if i in labels and labels[i].quality == 1]
    bad = [i for i in before if i in labels and labels[i].quality == 0]
    assert sum(i in after for i in good) >= 0.98 * len(good) > 0
    assert sum(i in after for i in bad) <= 0.3 * len(bad)
    scored = {r.doc_id: r.quality.score for r in quality.classify(docs, table(spark, sf_dir, "labels")).collect()}
    assert set(after) == {i for i, s in scored.items() if s >= quality.THRESHOLD}


def test_exact_stage(stages):
    before, after, *_ = stages["exact_dedup"]
    groups = {}
    for i, t in before.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    assert set(after) == {min(g)[1] for g in groups.values()}


def test_near_duplicate_stage(stages):
    before, after, *_ = stages["ngram_jaccard_join"]
    sets, up = {}, {i: i for i in before}
    for i, t in before.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in before if sets[i])
    for i in ids:
        for j in ids:
            if j < i and 100 * min(len(sets[i]), len(sets[j])) >= 80 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
    assert set(after) == {i for i in before if root(i) == i}


def test_decontamination_stage(spark, sf_dir, stages):
    before, after, *_ = stages["benchmark_decontamination"]
    windows = set()
    for r in table(spark, sf_dir, "benchmark").collect():
        ws = WORD.findall(lower(r.text))
        windows |= {tuple(ws[k : k + 13]) for k in range(max(1, len(ws) - 12))} if ws else set()
    sizes = {len(w) for w in windows}

    def clean(t):
        ws = WORD.findall(lower(t))
        hit = [False] * len(ws)
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
        runs = "".join("x" if h else " " for h in hit).split()
        return max(map(len, runs), default=0) < 13 and not (any(hit) and 20 * sum(hit) >= len(ws))

    assert set(after) == {i for i, t in before.items() if clean(t)} and len(after) < len(before)
    whole = [w for w in windows if len(w) == 13]
    for i in after:  # no occurrence of a whole window is left, however long its document is
        text = f" {' '.join(WORD.findall(lower(before[i])))} "
        assert not any(f" {' '.join(w)} " in text for w in whole)


def test_a_long_document_with_one_passage_goes(spark, sf_dir):
    item = table(spark, sf_dir, "benchmark").first().text
    filler = " ".join(f"filler{k}" for k in range(3000))
    docs = spark.createDataFrame([(1, f"{filler} {item} {filler}"), (2, filler)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs, sf_dir).collect()] == [2]


def test_mixing_stage(spark, sf_dir, stages, monkeypatch):
    fit = mixing.fit_rates  # a few steps: what is asserted holds for any rates, and the filters leave a target that cannot be met
    monkeypatch.setattr(mixing, "fit_rates", lambda table, targets, epochs: fit(table, targets, epochs, steps=10))
    docs = stages["benchmark_decontamination"][3]
    before = {r.doc_id: r.text for r in docs.collect()}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = Scratch(spark).keep(corpus_pipeline.mixing(spark, docs, sf_dir))
    assert out.columns == [*docs.columns, "n_tokens", "rate", "copies"]
    for r in out.collect():
        assert r.rate >= 0 and r.copies >= 1 and r.copies in (int(r.rate), int(r.rate) + 1)
        assert r.text == before[r.doc_id] and r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
