"""Mixing and the whole pipeline against plain versions that share no code with them."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldlake.llm import langid, mixing
from test_llm_text import brute_components, brute_hits, brute_spans

SF = "/root/testdata/sf0.001"


# mixing


def plain_topics(texts, k=6, steps=12):
    """Nearest centres of k-means over profiles of characters."""
    def numbers(t):
        t = t or ""
        shares = [1000 * len(re.findall(c, t)) // max(1, len(t)) for c in (r"[0-9]", r"[A-Z]", r"[!-/:-@\[-`{-~]", "\n", " ")]
        return (*shares, math.floor(math.log2(max(1, len(t))) * 100))

    x = np.array([numbers(t) for t in texts if t is not None], float)
    scale = np.sqrt(np.maximum(1.0, (x * x).mean(axis=0) - x.mean(axis=0) ** 2))
    far = lambda a, centres: np.stack([(((a - c) / scale) ** 2).sum(axis=1) for c in centres])
    seen = np.unique(x, axis=0)
    centres = []
    for _ in range(k):
        away = far(seen, centres or [x.mean(axis=0)]).min(axis=0)
        if centres and away.max() == 0:
            break
        centres.append(seen[np.argmax(away)])
    for _ in range(steps):
        own = far(x, centres).argmin(axis=0)
        new = [x[own == j].mean(axis=0) if (own == j).any() else c for j, c in enumerate(centres)]
        if all((a == b).all() for a, b in zip(new, centres)):
            break
        centres = new
    return [f"topic-{j}" for j in far(np.array([numbers(t) for t in texts], float), centres).argmin(axis=0)]


def plain_mix(cells, budget=0.5, temper=0.5, targets=None):
    """{cell: probability} for {(source, lang, topic): tokens}: raking until nothing moves, then a level found by bisection."""
    total = sum(cells.values())
    share = {c: n / total for c, n in cells.items()}
    goals = []
    for d in range(3):
        own = {}
        for c, n in cells.items():
            own[c[d]] = own.get(c[d], 0) + n
        goal = {v: targets[d].get(v, 0) for v in own} if targets and targets[d] else {v: n**temper for v, n in own.items()}
        goals.append({v: g / sum(goal.values()) for v, g in goal.items()})
    for _ in range(400):
        for d in range(3):
            sums = {}
            for c, s in share.items():
                sums[c[d]] = sums.get(c[d], 0) + s
            share = {c: s * goals[d][c[d]] / sums[c[d]] if sums[c[d]] else 0 for c, s in share.items()}
    low, high = 0.0, 1e6 * total
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(cells[c], level * s) for c, s in share.items()) < budget * total else (low, level)
    return {c: min(1.0, level * s / cells[c]) if cells[c] else 0.0 for c, s in share.items()}


def uniform(key, seed=1):
    return int(hashlib.md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:13], 16) / 2**52


def n_tokens(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("targets", [None, ({"a": 3, "b": 1, "c": 1, "zz": 5}, {"en": 1, "de": 1, "": 2}, {})])
def test_mixing_equals_a_plain_version(spark, targets):
    rnd = random.Random(2)
    texts = ["w " * rnd.randrange(1, 40) + rnd.choice(["", "A1!" * 20, "x\ny" * 9, "7" * 30]) for _ in range(500)] + [None, ""]
    rows = [(i, t, rnd.choice("aaab" if i % 2 else "bc"), rnd.choice(["en", "de", None]), "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, cell string")
    plan = mixing.Plan(budget=0.4, targets=dict(zip(mixing.DIMENSIONS, targets)) if targets else {})
    topics = plain_topics(texts)
    cells = {}
    for (i, t, source, lang, _), topic in zip(rows, topics):
        c = (source, lang or "", topic)
        cells[c] = cells.get(c, 0) + n_tokens(t)
    want = plain_mix(cells, 0.4, 0.5, targets)
    for r in mixing.mixed(df, plan).collect():
        c = (r.source, r.lang or "", topics[r.doc_id])
        assert r.mix.topic == c[2] and r.mix.cell_tokens == cells[c]
        assert r.mix.prob == pytest.approx(want[c], rel=1e-3, abs=1e-9)
        if abs(uniform(r.doc_id) - want[c]) > 1e-4:
            assert r.mix.drawn == (uniform(r.doc_id) < want[c])


def test_unmet_targets_are_reported(spark):
    df = spark.createDataFrame([(1, "a b", "s", "en"), (2, "a", "t", "de")], "doc_id long, text string, source string, lang string")
    plan = mixing.Plan(targets={"source": {"s": 0.9, "t": 0.1}, "lang": {"en": 0.1, "de": 0.9}})
    with pytest.warns(UserWarning, match="marginals are off"):
        assert mixing.mixed(df, plan, topic=F.lit("x")).count() == 2


# the pipeline


def plain_grams(data):
    text = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in data)
    out = {}
    for word in text.split(" "):
        padded = f" {word} " if word else ""
        for i in range(len(padded)):
            h = 0
            for n in (1, 2, 3):
                if i + n > len(padded):
                    break
                h = (h * 0x01000193 + ord(padded[i + n - 1]) + n) % 2**32
                if n == 1 and padded[i] == " " or padded == "  ":
                    continue
                slot = ((h ^ h >> 15) * 0x2C1B3C6D) % 2**32 >> 16
                out[slot] = out.get(slot, 0) + 1
    return out


def plain_languages(rows):
    """{doc: (language, share)} by the best of all sets of languages."""
    totals = {}
    for text, lang in {(r["text"], r["lang"]) for r in rows if r["text"] is not None and r["lang"] is not None}:
        own = totals.setdefault(lang, {})
        for slot, n in plain_grams(text.encode()).items():
            own[slot] = own.get(slot, 0) + n
    langs = sorted(totals)
    sums = {k: sum(totals[k].values()) + 0.05 * 65536 for k in langs}
    out = {}
    for r in rows:
        found = plain_grams((r["text"] or "").encode())
        if not found or not any(map(str.isalpha, r["text"])):
            continue
        c = np.array(list(found.values()), float)
        p = np.array([[(totals[k].get(slot, 0) + 0.05) / sums[k] for k in langs] for slot in found])
        best = None
        for k in range(1, len(langs) + 1):
            for own in itertools.combinations(range(len(langs)), k):
                pi = np.full(k, 1 / k)
                for _ in range(200 if k > 1 else 0):
                    s = p[:, own] @ pi
                    pi = pi * ((c / s) @ p[:, own]) / c.sum()
                value = c @ np.log(p[:, own] @ pi) - (k - 1) * (3 + 0.5 * math.log(c.sum()))
                best = max(best or (-math.inf,), (value, own, pi), key=lambda x: x[0])
        top = int(np.argmax(best[2]))
        out[r["doc_id"]] = langs[best[1][top]], best[2][top]
    return out


MORE_SECRETS = r"-----BEGIN [A-Z ]*PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}"


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    import corpus_pipeline

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in pd.read_parquet(f"{SF}/benchmark.parquet").itertuples()]
    odd = pd.DataFrame([(9001, "12 34"), (9002, None), (9003, ""), (9004, "the " * 3)], columns=["doc_id", "text"]).assign(lang="en", source="odd", n_chars=1)
    docs = pd.concat([docs, odd], ignore_index=True)
    docs.to_parquet(tmp_path / "documents.parquet")
    pd.read_parquet(f"{SF}/benchmark.parquet").to_parquet(tmp_path / "benchmark.parquet")
    rows = docs.astype(object).where(docs.notna(), None).to_dict("records")
    found = plain_languages(rows)
    rows = [r | {"lang": found[r["doc_id"]][0]} for r in rows if r["doc_id"] in found and found[r["doc_id"]][1] >= 0.5]
    kept = brute_components([r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])], 5, 80)
    rows = [r for r, k in zip(sorted(rows, key=lambda r: r["doc_id"]), kept) if k[3]]
    rows = [r for r in rows if not brute_hits(r["text"], bench)[1]]
    rows = [r for r in rows if not brute_spans(r["text"]) and not re.search(MORE_SECRETS, r["text"])]
    topics = plain_topics([r["text"] for r in rows])
    cells = {}
    for r, topic in zip(rows, topics):
        r["cell"] = (r["source"], r["lang"], topic)
        cells[r["cell"]] = cells.get(r["cell"], 0) + n_tokens(r["text"])
    probs = plain_mix(cells)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    sure = {r["doc_id"] for r in rows if uniform(r["doc_id"]) < probs[r["cell"]] - 1e-4}
    maybe = {r["doc_id"] for r in rows if uniform(r["doc_id"]) < probs[r["cell"]] + 1e-4}
    assert sure <= set(got) <= maybe and len(got) > 30
    by_id = {r["doc_id"]: r for r in rows}
    for i, r in got.items():
        assert (r.text, r.source, r.lang, r.topic) == (by_id[i]["text"], *by_id[i]["cell"]) and r.prob == pytest.approx(probs[by_id[i]["cell"]], rel=1e-3)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty tables; null ids, repeated ids, another text under the same id, clashing columns."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, topic string, predicted string, found string, kept string, gone_id long"
    bench = spark.createDataFrame([(1, "some item of the benchmark that nobody has ever seen before today"), (None, None)], "item_id long, text string")
    long = "Every morning the old baker walks down to the river and looks at the quiet boats before he opens his shop"
    other = "Nobody in this village remembers when the tall stone bridge was built or who paid the masons for their work"
    texts = [(None, long), (None, long), (1, long), (1, long), (1, other), (2, long + " again"), (3, None), (4, ""), (5, "some item of the benchmark that nobody has ever seen before today")]
    rows = [(i, t, "en", None, 1, "t", "p", "f", "k", 7) for i, t in texts]
    for name, df in (("full", spark.createDataFrame(rows, schema)), ("empty", spark.createDataFrame([], schema))):
        for k, own in (("documents", df), ("benchmark", bench.where(F.lit(name == "full")))):
            own.write.parquet(str(tmp_path / name / f"{k}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    docs, left = spark.read.parquet(str(tmp_path / "full" / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "full"))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(rows := out.collect(), out.schema)
        left.append(sorted((str(r.doc_id), r.text) for r in rows))
    assert left[0] == sorted((str(i), t) for i, t in texts if t)
    assert left[1] == sorted([("None", long)] * 2 + [("1", long)] * 2 + [("1", other), ("5", texts[-1][1])])
    assert left[3] == left[2] == [x for x in left[1] if x[0] != "5"]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path / "full"))
    assert mixed.columns == [*docs.columns, "_topic", "prob", "weight"]


def test_the_last_stage_learns_from_all_texts(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(mixing, "TOPIC_SAMPLE", 10, raising=False)
    texts = ["x" * 40 + str(10**i) * (i + 1) for i in range(15)] * 20 + ["a b C\n"] * 7
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    want = plain_topics(texts)
    got = {r.doc_id: r.topic for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()}
    assert got and all(topic == want[i] for i, topic in got.items())


@pytest.mark.parametrize("bits", [None, 1])
def test_the_first_stage_learns_from_all_texts(spark, monkeypatch, bits):
    import corpus_pipeline

    if bits:  # a filter that passes texts without copies as well
        monkeypatch.setattr(langid.urlfilter, "MIN_BITS", 64)
        monkeypatch.setattr(langid, "FILTER_BITS", bits)
    rnd = random.Random(6)
    own = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(3))
    rows = [(own("abcdefgh"), "en") for _ in range(4000)] + [(own("ghijkl"), "fr") for _ in range(300)]
    rows += rows[:50] * 3 + [(None, "en"), (own("xyz"), None)]
    docs = spark.createDataFrame([(i, t, k, "s") for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    models, learn = [], langid.learn
    monkeypatch.setattr(langid, "learn", lambda *a, **how: models.append(learn(*a, **how)) or models[-1])
    corpus_pipeline.identify_language(spark, docs, SF)
    counts = np.zeros((2, langid.SLOTS))
    for text, k in {(t, k) for t, k in rows if t and k}:
        for slot, n in plain_grams(text.encode()).items():
            counts[["en", "fr"].index(k), slot] += n
    assert models[0].langs == ["en", "fr"] and (models[0].p == langid.Mixture(["en", "fr"], counts).p).all()


def shuffled_bytes(spark, run):
    """What run() returns, and the bytes that its stages shuffled."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in map(found.apply, range(found.size()))}
    found = store.stageList(None, False, False, none, None)
    before = stages()
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = store.stageList(None, False, False, none, None)
    return out, sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("bits", [None, 1])
def test_texts_that_stay_are_not_shuffled(spark, monkeypatch, bits):
    """Whatever Spark can broadcast; with a filter of one bit an id most texts pass it, which changes no result."""
    import corpus_pipeline

    if bits:
        monkeypatch.setattr(langid.urlfilter, "MIN_BITS", 64)
        monkeypatch.setattr(langid.urlfilter, "ALONE_BITS", bits)
    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(1500)) for _ in range(300)]
    texts += [texts[3] + " more", texts[5], "of one id", texts[3] + " more still"]
    ids = [*range(302), 301, None]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = corpus_pipeline.stored(docs, "documents")
        got, moved = shuffled_bytes(spark, lambda: corpus_pipeline.drop_near_duplicates(spark, stored, SF).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = [x for k, x in enumerate(zip(ids, texts)) if k not in (300, 301)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bits or moved < sum(map(len, texts)) / 3
