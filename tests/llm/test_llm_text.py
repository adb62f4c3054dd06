"""Text operators against brute force on small fixtures: nulls, empty and long texts, ties, copies, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from foldlake.llm import bwt, decontaminate, langid, maxent, minhash, secrets
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.randrange(1, 120)) for _ in range(n)]
    out = [None, "", " \t\n", "One", "one  ONE", "ümlaut straße ümlaut", prose(rnd, 6000)]
    out += base + base[:10] + base[:2] * 5
    for t in base[:20]:
        w = t.split()
        for _ in range(rnd.randrange(1, 6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
        out.append(" ".join(w))
    line = prose(rnd, 30)
    return out + [f"{prose(rnd, 10)}\n{line}\n{prose(rnd, 10)}" for _ in range(12)]


# near-duplicates


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                one, two = find(i), find(j)
                parent[max(one, two)] = min(one, two)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    texts = corpus()
    got = minhash.near_duplicates(docs(spark, texts), size=size, percent=percent).collect()
    assert sorted(map(tuple, got)) == brute_components(texts, size, percent)


def test_chains_and_left_over_members(spark):
    """Members of one bucket that link with each other but not with the bucket's centre."""
    rnd = random.Random(5)
    base = prose(rnd, 150, 10**6).split()
    texts = []
    for k in range(40):
        w = base[:]
        for i in range(k % 9):
            w[(i * 16 + k) % 150] = f"e{k}x{i}" if k % 2 else f"shared{i}"
        texts.append(" ".join(w))
    rnd.shuffle(texts)
    got = minhash.near_duplicates(docs(spark, texts), size=3, percent=85).collect()
    assert sorted(map(tuple, got)) == brute_components(texts, 3, 85)


def test_blocks_find_the_links_of_left_over_members(spark):
    rows = [("b", 0, 0, 1, 10, list(range(20))), ("b", 0, 0, 2, 20, list(range(1, 21)))]
    schema = "bucket string, i int, j int, id long, component long, own array<long>"
    side = spark.createDataFrame(rows, schema)
    other = spark.createDataFrame(rows, schema)
    assert {tuple(sorted(r)) for r in minhash._block_links(side, other, 85).collect()} == {(1, 2)}


def test_near_duplicates_without_rows_or_ids(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False)], key=str)


# decontamination


def brute_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, met = split(text), set(), set()
    for item, t in items:
        own = split(t)
        for i in range(max(1, len(own) - 9) if own else 0):
            window = own[i : i + 10]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    met.add(str(item))
    return len(w), len(hit), sorted(met)


def test_contamination(spark):
    rnd = random.Random(2)
    items = [(1, prose(rnd, 25, 30)), (2, "short item"), (3, ""), (4, None), (5, "the"), (10, prose(rnd, 10, 30)), (11, "a! b?? c"), (12, prose(rnd, 12))]
    texts = corpus(3, 20) + [f"{prose(rnd, 5)} {items[0][1].upper()} x", "Short, ITEM", items[0][1][20:], "thethe the.the", f"{items[5][1]} {items[5][1]}", "a b c d"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, items) for i, t in enumerate(texts)}
    df = docs(spark, texts).withColumn("found", F.lit("clashes"))
    for block_bytes in (1 << 20, 40):  # one block, and several
        out = decontaminate.matches(df, bench, block_bytes=block_bytes)
        name = out.columns[-1]
        got = {r.doc_id: (r[name].n_words, r[name].n_hit, r[name]["items"]) for r in out.collect()}
        assert got == want
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w[1]}


def test_longest_match_and_empty_benchmark(spark):
    words = [f"t{i}" for i in range(30)]
    bench = spark.createDataFrame([("q", " ".join(words))], "item_id string, text string")
    df = docs(spark, ["x " + " ".join(words[3:20]) + " y " + " ".join(words[:10])])
    found = decontaminate.matches(df, bench).first().found
    assert (found.longest, found.n_hit, [(s.start, s.end) for s in found.spans]) == (17, 27, [(1, 18), (19, 29)])
    assert decontaminate.matches(df, bench.where("false")).first().found.n_hit == 0
    assert decontaminate.matches(df.where("false"), bench).count() == 0


def test_longest_matches_follow_the_item(spark, monkeypatch):
    """A text that goes on elsewhere in a periodic item is no longer match; repeated rows and items, null ids, several shards."""
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 64)
    period = " ".join(["a b c d e f g h i j"] * 2 + ["x"] + ["b c d e f g h i j q"])
    items = [(1, period), (1, period), (None, "m n o p q r s t u v w"), (2, "k k k k k k k k k k k k")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "a b c d e f g h i j q"), (1, "a b c d e f g h i j q"), (None, "k " * 15), (3, "z"), (4, "m n o p q r s t u v w m n o p q r s t u v")]
    out = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), bench).collect()
    got = {(r.doc_id, r.found.n_hit, r.found.longest, tuple(r.found["items"])) for r in out}
    assert len(out) == 5
    assert got == {(1, 11, 10, ("1",)), (None, 15, 12, ("2",)), (3, 0, 0, ()), (4, 21, 11, ("null",))}


# repeated passages


def brute_removed(texts):
    seen, out = {}, []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = set()
        for k in range(len(b) - 49):
            if seen.setdefault(b[k : k + 50], i) < i:
                gone.update(range(k, k + 50))
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((i, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("sizes", [{}, {"HOT": 1}, {"HOT": 3, "FREQUENT": 1000}, {"FREQUENT": 10**9}])
def test_repeated_passages(spark, monkeypatch, sizes):
    """As it is; most anchors shared by several tasks; all repeated anchors frequent; none frequent."""
    for k, v in sizes.items():
        monkeypatch.setattr(bwt, k, v)
    if sizes.get("FREQUENT") == 10**9:
        import numpy as np

        monkeypatch.setattr(bwt, "_frequent", lambda docs, n: np.zeros(0, np.uint64))
    rnd = random.Random(4)
    texts = corpus(4, 30) + ["a" * 300, "a" * 49, "b" + "a" * 120, "ab" * 100, "é" * 60, "x" + "é" * 40, "\0" * 70]
    rnd.shuffle(texts)
    df = docs(spark, texts).withColumns({k: F.lit("clash") for k in ("id", "data", "bucket", "anchor", "spans", "shard")})
    got = bwt.deduplicated(df).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute_removed(texts)


def test_repeated_passages_with_odd_ids(spark):
    t = "0123456789" * 7
    rows = [(None, t), (1, t), (2, t), (2, t), (3, t), (3, t + "!")]
    got = bwt.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("id", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 0), (1, 0), (2, 70), (2, 70), (3, 0), (3, 0)], key=str)
    assert bwt.deduplicated(docs(spark, [])).count() == 0


def test_stretches_are_told_apart_by_64_bits(spark):
    import numpy as np

    data = bytes(random.Random(5).choices(b"abcdefgh ", k=300))
    rows = bwt._anchors(spark.createDataFrame([(1, data)], "id long, data binary"), 1, np.zeros(0, np.uint64)).collect()
    carried = b"".join(bytes(r.own) for r in rows)
    assert carried == bwt.stretches(data)[1].tobytes()
    own = [9 | 1 << 40, 9 | 1 << 41, 9 | 5 << 32, 8 | 5 << 32, 8 | 5 << 32]  # 32 bits of either half are equal for some
    a = {"anchor": [7] * 5, "own": own, "id": [1, 2, 3, 4, 5], "start": [0] * 5, "length": [60] * 5}
    packed = {k: np.array(v, np.uint64).astype(bwt.KINDS[k]).tobytes() for k, v in a.items()}
    met = bwt._met(spark.createDataFrame([(0, *(bytearray(packed[k]) for k in bwt.KINDS))], bwt.ANCHORS), 1).collect()
    assert sorted((r.id, r.open) for r in met) == [(1, True), (2, True), (3, True), (4, True), (5, False)]


@pytest.mark.parametrize("letters", [b"ab", bytes(range(256))])
def test_merged_transforms_order_suffixes(letters):
    rnd = random.Random(1)
    shards = [[bytes(rnd.choice(letters) for _ in range(rnd.randrange(0, 30))) for _ in range(30)] + [letters] for _ in range(2)]
    built = [bwt.shard_transform(s) for s in shards]
    source, interval = bwt.merge_transforms(built[0][0], built[1][0], 8)
    take = [iter(zip(b[1], b[2])) for b in built]
    suffixes = []
    for s in source.astype(int):
        i, o = next(take[s])
        suffixes.append(shards[s][i][o:][:8])
    assert suffixes == sorted(suffixes)
    for a, b, x, y in zip(suffixes, suffixes[1:], interval, interval[1:]):
        assert (a == b) == (x == y)


# secrets


def brute_spans(text):
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


SECRETS = [
    "PassWord: hunter2xyz and api_key='abcdef'", "secret=token: abcdef12", "token=a secret=abcdefg", "é😀 token = \"zzzzzz\" x",
    "AKIA" + "A1" * 9, "AKIAAKIA" + "B" * 11, "0123456789abcdef01234567", "x" + "deadbeef" * 4 + "g" + "a" * 23, "apikey=abcde", None, "",
    "secret:" + "0" * 30, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36,
]


def test_secret_spans(spark):
    df = docs(spark, SECRETS + SECRETS[:3] * 4).withColumn("blob", F.lit(1)).withColumn("spans", F.lit(2))
    out, ledger = secrets.scan_with_ledger(df)
    name = out.columns[-1]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r[name] if s.kind_no < 3] for r in out.collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(SECRETS + SECRETS[:3] * 4)}
    assert {r.doc_id for r in out.where(F.size(name) > 0).collect()} >= {12, 13}
    assert ledger.count() == len({t or "" for t in SECRETS})
    clean = secrets.without_secrets(df)
    assert clean.columns == df.columns and clean.where("spans <> 2").count() == 0 and {8, 9, 10} <= {r.doc_id for r in clean.collect()}


def test_texts_with_very_many_matches(spark):
    rnd = random.Random(8)
    parts = ["deadbeef" * 3, "token=abcdef1", "é😀 x", "AKIA" + "B" * 16, "secret: a", "0" * 23]
    texts = [" ".join(rnd.choices(parts, k=n)) for n in (255, 256, 257, 700, 20_000)]
    df = spark.createDataFrame([(None, texts[0])] + list(enumerate(texts)), "doc_id long, text string").withColumn("lengths_0", F.lit(0))
    out, _ = secrets.scan_with_ledger(df)
    got = sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans if s.kind_no < 3]) for r in out.collect())
    assert got == sorted([("None", brute_spans(texts[0]))] + [(str(i), brute_spans(t)) for i, t in enumerate(texts)])


def test_only_unseen_blobs_are_scanned(spark):
    first, ledger = secrets.scan_with_ledger(docs(spark, SECRETS))
    again, new = secrets.scan_with_ledger(docs(spark, [*SECRETS, "token: abcdefgh"]), ledger)
    assert new.count() == 1
    assert again.where(F.size("spans") > 0).count() == first.where(F.size("spans") > 0).count() + 1
    _, other = secrets.scan_with_ledger(docs(spark, SECRETS), ledger, rules=secrets.BASE)
    assert other.count() == ledger.count()  # another version of the rules
    assert secrets.scan_with_ledger(docs(spark, []))[0].count() == 0


# languages


def test_language_accuracy_and_odd_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = langid.fold_of("doc_id", 4)
    model = langid.learn(rows.where(fold != 2))
    out = langid.predict(rows, model)
    held = out.where(fold == 2)
    assert held.where("lang = predicted.lang").count() >= 0.97 * held.count()
    odd = langid.predict(docs(spark, [None, "", "123 !!", "日本", "x" * 200_000]).withColumn("predicted", F.lit(0)), model).collect()
    assert [r[-1].lang for r in odd][:3] == ["und"] * 3 and all(0 <= r[-1].score <= 1 for r in odd)


def test_mixtures(spark):
    rnd = random.Random(3)
    words = {"aa": ["abba", "baba", "abab"], "cc": ["cddc", "dcdc", "ccdd"], "ee": ["effe", "feef", "eeff"]}
    text = lambda k, n: " ".join(rnd.choice(words[k]) for _ in range(n))
    train = spark.createDataFrame([(text(k, 50), k) for k in words for _ in range(20)], "text string, lang string")
    model = langid.learn(train)
    found = langid.predict(spark.createDataFrame([(text("aa", 60) + " " + text("cc", 30),), (text("ee", 40),)], "text string"), model).collect()
    assert found[0].predicted.langs == ["aa", "cc"] and abs(found[0].predicted.shares[0] - 2 / 3) < 0.05
    assert found[1].predicted.langs == ["ee"] and found[1].predicted.score == 1
    assert langid.predict(train, langid.learn(train.where("false"))).where("predicted.lang <> 'und'").count() == 0


def test_a_label_with_copies_of_one_text_is_learned(spark):
    rnd = random.Random(2)
    own = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(n))
    for _ in range(3):
        one = own("qxzw", 30)
        train = spark.createDataFrame([(one, "fr")] * 4000 + [(own("aeio", 30), "en") for _ in range(400)], "text string, lang string")
        model = langid.learn(train, rows=100)
        assert model.langs == ["en", "fr"]
        rows = [(None, one), (None, one), (1, own("aeio", 9))]
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("de"), "data_of_text": F.lit(0)})
        assert sorted(r.predicted.lang for r in langid.predict(df, model).collect()) == ["en", "fr", "fr"]


def test_ties_go_to_the_language_that_sorts_first():
    import numpy as np

    counts = np.array([[5.0, 1, 3], [5.0, 1, 3]])
    assert langid.Mixture(["b", "c"], counts).infer(np.arange(3), np.array([4.0, 1, 1]))[0][0] == "b"


def test_mixtures_equal_the_best_of_all_sets():
    """Against every set of languages, each fitted by plain expectation-maximisation."""
    import itertools

    import numpy as np
    import pandas as pd

    rows = pd.read_parquet("/root/testdata/sf0.001/documents.parquet", columns=["text", "lang"]).dropna()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), langid.SLOTS))
    for t, k in zip(rows["text"][::2], rows["lang"][::2]):
        slots, c = langid.grams(t.encode())
        counts[langs.index(k)][slots] += c
    model, rnd = langid.Mixture(langs, counts), random.Random(4)
    texts = [t for t in rows["text"][1::2] if t.strip()]
    for _ in range(40):
        text = "\n".join(t[: rnd.randrange(50, 900)] for t in rnd.sample(texts, rnd.randrange(1, 4)))
        slots, c = langid.grams(text.encode())
        p, n = model.p[slots].astype(float), c.sum()
        best = None
        for k in range(1, len(langs) + 1):
            for own in itertools.combinations(range(len(langs)), k):
                pi = np.full(k, 1 / k)
                for _ in range(400):
                    s = p[:, own] @ pi
                    pi = pi * ((c / s) @ p[:, own]) / n
                value = c @ np.log(p[:, own] @ pi) - (k - 1) * (langid.PENALTY + 0.5 * np.log(n))
                best = max(best or (-np.inf,), (value, own, pi), key=lambda x: x[0])
        found = dict(model.infer(slots, c))
        assert set(found) == {langs[k] for k in best[1]}
        assert all(abs(found[langs[k]] - share) < 0.02 for k, share in zip(best[1], best[2]))


def test_every_candidate_language_is_tried():
    import numpy as np

    r = np.random.default_rng(9)
    counts = np.full((7, 12), 5.0)
    counts[0, :5] = 2000
    counts[1:6] = r.integers(1, 200, (5, 12))
    for k in range(1, 6):  # each has a slot of its own: large gradients, small gains
        counts[k, 5 + k] = r.integers(3000, 200_000)
    counts[6, 11], counts[6, :5] = r.integers(500, 3000), r.integers(500, 3000, 5)
    c = np.zeros(12)
    c[:5], c[6:11], c[11] = r.integers(100, 400, 5), r.integers(1, 12, 5), r.integers(5, 200)
    found = langid.Mixture(list("abcdefg"), counts).infer(np.arange(12), c)
    assert {x for x, _ in found} == {"a", "d", "g"}


# language model


def test_scores(spark):
    texts = corpus(7, 80)
    df = docs(spark, texts)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [[*(t or "").lower().encode().split(), b""] for t in texts]
    c = Counter(w for i, t in enumerate(tokens) if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    out = {r.id: r for r in maxent.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).collect()}
    assert len(out) == len(texts)
    import math

    for i, t in enumerate(tokens):
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - want) < 1e-9 * max(1, abs(want)) and r.score < 0


def test_rare_words_count_exactly(spark, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 20)  # nearly all words go through the join
    test_scores(spark)


def small_tree():
    import numpy as np

    rnd = np.random.default_rng(0)
    return maxent.Tree(np.concatenate([np.sort(rnd.zipf(1.3, 900).clip(max=10**6))[::-1], np.arange(maxent.TAIL) + 1]).astype(float))


def test_model_is_a_distribution():
    import numpy as np

    rnd, tree = np.random.default_rng(0), small_tree()
    w = maxent.Model.start(tree)
    model = maxent.Model(tree, w + rnd.normal(size=w.shape).astype(np.float32))
    before = rnd.integers(0, tree.n_leaves, 3)
    symbols = np.concatenate([np.concatenate([before, [s]]) for s in range(tree.n_leaves)])
    log_p = model.log_probabilities(symbols, np.arange(tree.n_leaves) * 4 + 3)
    assert tree.depth > 2 and abs(np.exp(log_p).sum() - 1) < 1e-3
    assert tree.length[0] < tree.length[899]  # frequent words take fewer decisions
    steep = maxent.Model(tree, w * 0 + np.float32(200))  # exponentials without a finite value
    assert np.isfinite(steep.log_probabilities(symbols, np.arange(tree.n_leaves) * 4 + 3)).all()


@pytest.mark.parametrize("n", [1, 2, maxent.WIDTH, maxent.WIDTH + 1, 200])
def test_trees_of_any_size(n):
    import numpy as np

    tree = maxent.Tree(np.arange(1.0, n + 1))
    ways = {tuple((tree.nodes[d, k], tree.digits[d, k]) for d in range(tree.length[k])) for k in range(n)}
    assert len(ways) == n and tree.n_nodes == -(-(n - 1) // (maxent.WIDTH - 1)) + (n == 1)
    assert abs(np.exp(maxent.Model(tree, maxent.Model.start(tree)).log_probabilities(np.repeat(np.arange(n), 4), np.arange(n) * 4 + 3)).sum() - 1) < 1e-3


def brute_model(tree, stretches, steps):
    """The weights after the given steps, by loops over tokens in double precision."""
    import numpy as np

    w = {r: row.astype(float) for r, row in enumerate(maxent.Model.start(tree))}
    seen = Counter()

    def decisions(s, i):
        for d in range(tree.length[s[i]]):
            node = int(tree.nodes[d, s[i]])
            history = {"last": s[i - 1], "skip": s[i - 2], "third": s[i - 3], "pair": s[i - 1] * (tree.n_leaves + 1) + s[i - 2]}
            kinds = maxent.FEATURES[min(d, 2)]
            rows = [int(maxent.Model.hashed(k, np.array([history[k]]), np.array([node]), d)[0]) for k in kinds]
            yield d, int(tree.digits[d, s[i]]), [node + int(maxent.OFFSETS[-1]), *rows]

    def chances(rows):
        z = sum(w[r] for r in rows)
        e = np.exp(z - z.max())
        return e / e.sum()

    for s, places in [(s, places[i : i + steps]) for s, places in stretches for i in range(0, len(places), steps)]:
        for depth in range(tree.depth):
            sums = {}
            for i in places:
                for d, digit, rows in decisions(s, i):
                    if d == depth:
                        g = -chances(rows)
                        g[digit] += 1
                        for r in rows:
                            sums[r] = sums.get(r, 0) + g
            for r, g in sums.items():
                seen[r] += (g * g).mean()
                w[r] = w[r] + maxent.RATE / np.sqrt(seen[r] + 1e-3) * g
    return lambda s, i: sum(np.log(chances(rows)[digit]) for _, digit, rows in decisions(s, i))


def test_training_and_scores_equal_brute_force(spark):
    """The whole query on one task: counts, tree, steps in the order of the rows, scores; changes are kept in 16 bits."""
    import numpy as np

    texts = ["a b c a b d", None, "b c a", "x y b c a b", "A\tb  c a b", "q r s t u v w x y z a b c", "a b c a b d e"] * 3
    held = [k % 7 == 4 for k in range(len(texts))]
    df = docs(spark, texts).coalesce(1)
    got = {r.id: r.score for r in maxent.score(df, F.col("doc_id") % 7 == 4, rounds=1).collect()}
    tokens = [[*(t or "").lower().encode().split(), b""] for t in texts]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    order = sorted(c, key=lambda w: (w != b"", -c[w], w))
    tree = maxent.Tree(np.array([c[w] for w in order] + [1] * maxent.TAIL, float))
    leaf = lambda w: order.index(w) if w in c else len(order) + maxent.tail_class(w)
    padded = [[tree.n_leaves] * 3 + [leaf(w) for w in t] for t in tokens]
    flat, places = [], []
    for t, h in zip(padded, held):
        if not h:
            places += range(len(flat) + 3, len(flat) + len(t))
            flat += t
    log_p = brute_model(tree, [(flat, places)], maxent.EAGER_BATCH)
    for k, t in enumerate(padded):
        want = sum(log_p(t, i) for i in range(3, len(t))) / np.log(10)  # words out of the vocabulary have all of their class
        assert abs(got[k] - want) < 5e-3 * abs(want), (k, got[k], want)


def test_rare_rows_keep_their_changes(spark):
    """A row that one of many tasks meets is not averaged with the tasks that don't."""
    import numpy as np

    tree = small_tree()
    common, rare = np.array([1, 2, 3] * 40, np.int32), np.array([500, 501, 502] * 40, np.int32)
    rows = [(common.tobytes(), 0)] * 7 + [(rare.tobytes(), 0)]
    one = spark.createDataFrame(rows[-1:], "leaves binary, part int").coalesce(1)
    alone, mixed = maxent.train(one, tree, 1), maxent.train(spark.createDataFrame(rows, "leaves binary, part int").repartition(8), tree, 1)
    row = maxent.Model.hashed("pair", np.array([501 * (tree.n_leaves + 1) + 500]), np.array([tree.nodes[0, 502]]), 0)[0]
    assert np.abs(alone[row]).max() > 0.05 and np.abs(mixed[row] - alone[row]).max() < 0.3 * np.abs(alone[row]).max()


def test_training_learns_context(spark):
    rnd = random.Random(1)
    one, two = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    texts = [" ".join(rnd.choice(own) for _ in range(60)) for k in range(150) for own in (one, two)]
    rows = maxent.score(docs(spark, texts), F.col("doc_id") % 10 == 0).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.2 * sum(r.n_tokens for r in rows)


def test_late_tokens_train_all_features(spark):
    """Tokens after a task's first steps move the rows of all their features."""
    import numpy as np

    tree = small_tree()
    early, late = np.array([1, 2, 3, 4, 5, 0] * 12_000, np.int32), np.array([700, 701, 702, 703], np.int32)
    w = maxent.train(spark.createDataFrame([(early.tobytes(), 0), (late.tobytes(), 0)], "leaves binary, part int").coalesce(1), tree, 1)
    model = maxent.Model(tree, w)
    symbols = np.concatenate([[tree.n_leaves] * 3, late]).astype(np.int64)
    for depth in range(tree.length[703]):
        at = np.array([6])
        for row in model.rows(symbols, at, tree.nodes[depth][symbols[at]], depth):
            assert (w[row[0]] != maxent.Model.start(tree)[row[0]]).any()


def test_scores_of_odd_tables(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit("clash") for k in ("id", "row", "part", "leaves", "word", "n", "held_out")})
    got = maxent.score(df, F.coalesce(F.col("doc_id") == 2, F.lit(False))).collect()
    assert sorted((str(r.id), r.n_tokens, r.held_out, r.train_tokens) for r in got) == [
        ("1", 4, False, 13), ("1", 4, False, 13), ("2", 1, True, 13), ("None", 1, False, 13), ("None", 4, False, 13)]
    assert len({r.score for r in got if r.n_tokens == 4}) == 1


def test_scores_without_rows(spark):
    held_out = F.lit(False)
    assert maxent.score(docs(spark, []), held_out).count() == 0
    assert maxent.score(docs(spark, ["a b", None]), F.lit(True)).count() == 2
