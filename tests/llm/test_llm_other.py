"""Archives, embeddings, url rules, mixing and components on small fixtures."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.llm import itq, mixing, urlfilter, warc
from foldlake.llm.components import components

# archives

PAGES = [
    (1, "http://www.Example.com/a?b=1#c", "x" * 150), (2, "https://example.com:8080/", "x" * 150), (3, None, None), (4, "no scheme", ""),
    (5, "http://a.b/é%20 \r\n\r\nWARC/1.1", "line\r\n\r\nWARC/1.1\r\nünïcode"), (6, "http://a.b/", "y" * 99), (7, "http://a.b/", "y" * 99),
    (8, "http://long/" + "p" * 900, "z" * 300_000), (9, "http://long/" + "p" * 900, "z" * 300_000), (None, "http://a.b/", "x" * 150), (10, "http://a.b/", "x" * 150),
]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = str(tmp_path / "warc")
    entries = warc.write_archives(pages, folder, shard_bytes=200_000)
    records = {(r.page_id, r.payload_digest): r for r in warc.read_archives(spark, folder).collect()}
    assert len(records) == len(PAGES)
    for page, url, html in PAGES:
        data = (html or "").encode()
        r = records[page, hashlib.sha256(data).hexdigest()]
        assert r.intact and r.url == (url or "") and r.payload_bytes == len(data)
        refers = {2: 1, 9: 8, 10: 1}.get(page)
        assert (r.record_type, r.refers_to, r.stored_bytes) == (("revisit", refers, 0) if refers else ("response", None, len(data)))
    index = warc.CaptureIndex.build(entries, block_entries=2)
    assert len(index.directory) > 3
    found = index.locate(pages.select(warc.reversed_key("url").alias("key"), "page_id"))
    assert {(r.page_id, r.shard, r.offset, r.length) for r in found.collect()} == {(r.page_id, r.shard, r.offset, r.length) for r in records.values()}
    key = pages.where("page_id = 8").select(warc.reversed_key("url")).first()[0]
    hits = index.lookup(key)
    assert len(key) <= warc.KEY_CHARS and sorted(h[1] for h in hits) == [8, 9]
    h = next(h for h in hits if h[1] == 8)
    headers, payload = warc.read_range(spark, folder, h[2], h[3], h[4])
    assert headers["warc-type"] == "response" and payload == b"z" * 300_000
    assert index.lookup("com,nowhere)/") == []
    every = entries.select("shard", "offset", "length")
    got = {(r.page_id, r.payload_digest) for r in warc.read_ranges(spark, folder, every).collect()}
    assert got == set(records)
    some = warc.read_ranges(spark, folder, entries.where("page_id in (2, 8)")).collect()
    assert sorted((r.page_id, r.record_type) for r in some) == [(2, "revisit"), (8, "response")]
    with pytest.raises(Exception, match="missing"):
        warc.read_ranges(spark, folder, entries.withColumn("shard", F.lit(999))).collect()
    with pytest.raises(Exception, match="damaged|as long"):
        warc.read_ranges(spark, folder, entries.withColumn("length", F.col("length") - 9)).collect()


def test_a_damaged_archive_fails(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "some page"), (1, "http://a/", "some page"), (1, "http://a/", "another")], "page_id long, url string, html string")
    entries = warc.write_archives(pages, str(tmp_path / "w"))
    assert entries.count() == 3  # repeated ids are records of their own
    assert warc.CaptureIndex.build(entries).locate(entries.select("key", "page_id")).count() == 3
    (file,) = (tmp_path / "w").glob("shard=0/part-*")
    data = bytearray(file.read_bytes())
    data[40] ^= 255
    file.write_bytes(bytes(data))
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="damaged|digest"):
        warc.read_archives(spark, str(tmp_path / "w")).collect()


def test_keys_sort_by_reversed_host(spark):
    df = spark.createDataFrame([("http://www.Example.com/a?b=1#c",), ("https://example.com:8080/",), (None,)], "url string")
    assert [r[0] for r in df.select(warc.reversed_key("url")).collect()] == ["com,example,www)/a?b=1", "com,example)/", ""]


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    entries = warc.write_archives(pages, str(tmp_path / "w"))
    index = warc.CaptureIndex.build(entries)
    assert entries.count() == 0 and index.directory == [] and index.locate(entries).count() == 0


# embeddings


def brute_links(vectors, ids=None):
    ok = [bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(vectors)
    unit = [np.array(v, float) / max(map(abs, v)) if o else None for v, o in zip(vectors, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            link[i, j] = i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
    return link.sum(axis=1), label


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 8, "DENSE": 0}, {"HELD": 300, "BLOCK": 8}, {"DENSE": 2, "FEWEST": 10**6}])
def test_embedding_links(spark, monkeypatch, sizes):
    """Pairs listed, all or some buckets dense, deals too large to hold, hyperplanes only."""
    for k, v in sizes.items():
        monkeypatch.setattr(itq, k, v)
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(120, 16))
    rows = [v.tolist() for v in base] + [v.tolist() for v in base[:5]] * 3
    rows += [(base[0] + 0.02 * rnd.normal(size=16)).tolist() for _ in range(60)]
    rows += [(base[i] + 0.3 * rnd.normal(size=16)).tolist() for i in range(60)]
    rows += [None, [], [0.0] * 16, [1.0] * 15 + [float("nan")], [1.0] * 15 + [None], [1.0] * 3, [float("inf")] + [0.0] * 15]
    rows += [[1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [-1.0, 2.0, 3.0], [2.0], [5.0], [-5.0], [1.0] * 15, [1.0] * 14 + [1.25]]
    rows = [None if v is None else [x if x is None else float(np.float32(x)) for x in v] for v in rows]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    df = df.withColumns({k: F.lit(1) for k in ("many", "h1", "id", "vec", "usable")})
    got = sorted(itq.near_duplicates(df).collect())
    links, label = brute_links(rows)
    found = np.array([r.n_links for r in got])
    assert len(got) == len(rows) and (found <= links).all() and found.sum() >= 0.97 * links.sum()
    assert sum(r.component_id != label[r.id] for r in got) <= 0.03 * len(rows)
    assert (found[-8:] == links[-8:]).all() and found[-8] >= 1


def test_double_components_keep_their_range(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e300, 9e299]), (3, [1e-60, 1e-60]), (4, [-1e-60, 1e-60]), (None, [1.0, 1.1]), (None, None), (5, [1e300, 1e300]), (5, [1e300, 1e300])]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {(1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (4, 0, 4, True), (None, 5, None, True), (None, 0, None, True), (5, 5, 1, False)}
    assert set(map(tuple, got)) == want and len(got) == 8
    alone = itq.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (None, [2.0, 0.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in alone.collect()] == [(None, 1, None, True)] * 2


def test_recall_at_the_threshold():
    rnd = np.random.default_rng(3)
    a = rnd.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rnd.normal(size=a.shape)
    other -= (other * a).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * other / np.linalg.norm(other, axis=1, keepdims=True)
    q = itq.learn(a, 8000)
    (w1, p1), (w2, p2) = q.codes(a), q.codes(b)
    met = (p1 == p2).any(axis=1) & (np.bitwise_count(w1 ^ w2).sum(axis=1) <= q.most)
    assert met.mean() > 0.95


@pytest.mark.parametrize("common", [0.5, 0.7])
def test_recall_with_a_common_direction(common):
    rnd = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(np.sqrt(common) * unit(rnd.normal(size=(1, 64))) + np.sqrt(1 - common) * unit(rnd.normal(size=(6000, 64))))
    other = rnd.normal(size=a.shape)
    other -= (other * a).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * unit(other)
    q = itq.learn(a[:4000], 100_000)
    (w1, p1), (w2, p2) = q.codes(a[4000:]), q.codes(b[4000:])
    met = (p1 == p2).any(axis=1) & (np.bitwise_count(w1 ^ w2).sum(axis=1) <= q.most)
    assert met.mean() > 0.95


def test_no_embeddings(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert itq.near_duplicates(none).count() == 0
    assert [tuple(r) for r in itq.near_duplicates(spark.createDataFrame([(4, None)], none.schema)).collect()] == [(4, 0, 4, True)]


# components


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        one, two = find(a), find(b)
        parent[max(one, two)] = min(one, two)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# url rules


def brute_rule(url, rules=urlfilter.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fit, key=lambda r: (-len(r.key), r.key, r.verdict != "block"), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_url_rules(spark):
    rnd = random.Random(1)
    urls = [None, "", "x", "://", "http://", "http://COM/en/", "http://notcom/en/", "http://a.example.com/en/77?q#z", "http://example.net/de/8", "http://x.net/de/8",
            "http://example.net?de/8", "http://example.org/es/#", "HTTP://Ex.ORG/es", "http://org.com/en/7", "http://example.com.net/de/", "a://b://c.com/en/x"]
    urls += [f"http://{'.'.join(rnd.choice(['a', 'example', 'com', 'net', 'org']) for _ in range(rnd.randrange(1, 5)))}/{rnd.choice(['en', 'de', 'es'])}/{rnd.randrange(99)}" for _ in range(400)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, judged string")
    out = urlfilter.judge(df)
    assert [tuple(r[out.columns[-1]]) for r in out.orderBy("page_id").collect()] == [brute_rule(u) for u in urls]
    assert urlfilter.judge(df, rules=()).where("_judged.verdict <> 'allow'").count() == 0
    assert urlfilter.judge(df.where("false")).count() == 0


@pytest.mark.parametrize("most", [urlfilter.MAX_BITS, 1 << 12])
def test_long_lists_in_one_part_or_several(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "MAX_BITS", most)
    rnd = random.Random(6)
    names = ["a", "b", "ab", "c.d", "example", "x" * 300]
    rules = [urlfilter.UrlRule(".".join(rnd.choices(names, k=rnd.randrange(1, 4))), "/" + "".join(rnd.choices("ab/", k=rnd.randrange(4))), rnd.choice(["allow", "block"])) for _ in range(900)]
    urls = [None, "://", "http://a/" + "ab" * 5000] + [f"http://{'.'.join(rnd.choices(names, k=rnd.randrange(1, 6)))}/{''.join(rnd.choices('ab/', k=9))}?q" for _ in range(300)]
    df = spark.createDataFrame([(1, u) for u in urls * 2], "page_id long, url string")  # repeated pages and ids
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    out = urlfilter.judge(df, table)
    assert len(urlfilter.partitioned(table.select(F.concat("host", "path").alias("key")), df.select(F.col("url").alias("key")).dropna())) == (1 if most > 1 << 20 else 2)
    assert sorted((str(r.url), *r.judged) for r in out.collect()) == sorted((str(u), *brute_rule(u, rules)) for u in urls * 2)


def test_cascade_is_exact_on_its_universe(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS", 2)  # many false positives, so that several levels are needed
    monkeypatch.setattr(urlfilter, "MIN_BITS", 64)
    every = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    levels = urlfilter.cascade(every.where("listed"), every)
    assert len(levels) > 2
    assert every.where(urlfilter.is_listed(F.col("key"), levels) != F.col("listed")).count() == 0


# mixing


def test_marginals_and_budget(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randrange(1, 40), rnd.choice("abc"), rnd.choice(["en", "de", None]), rnd.choice(["p", "q"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, t string").withColumn("mix", F.lit(1))
    plan = mixing.Plan(budget=0.3, targets={"source": {"a": 3, "b": 1, "c": 1, "zz": 5}, "lang": {"en": 1, "de": 1, "": 2}})
    out = mixing.mixed(df, plan, topic=F.col("t"))
    m = out.columns[-1]
    assert out.count() == 600
    cells = out.select("source", F.coalesce("lang", F.lit("")).alias("lang"), f"{m}.topic", f"{m}.share", f"{m}.prob", f"{m}.cell_tokens").distinct().toPandas()
    by = lambda k: cells.groupby(k)["share"].sum().to_dict()
    assert by("source") == pytest.approx({"a": 0.6, "b": 0.2, "c": 0.2}, abs=1e-5)
    assert by("lang") == pytest.approx({"en": 0.25, "de": 0.25, "": 0.5}, abs=1e-5)
    assert (cells.prob * cells.cell_tokens).sum() == pytest.approx(0.3 * cells.cell_tokens.sum(), rel=1e-6)
    drawn = mixing.draw(df, plan, topic=F.col("t"))
    assert 0.15 * 600 < drawn.count() < 0.5 * 600 and drawn.count() == mixing.draw(df, plan, topic=F.col("t")).count()


def test_many_cells_use_joins(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 5).alias("source"), (F.col("id") % 3).alias("lang"))
    few = {r.doc_id: r[-1].prob for r in mixing.mixed(df).collect()}
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    assert {r.doc_id: r[-1].prob for r in mixing.mixed(df).collect()} == pytest.approx(few)


def test_many_cells_take_all_rounds(spark, monkeypatch):
    rows = [(f"s{i}", f"l{j}", "t", 1 + (7 * i + 3 * j) % 11) for i in range(12) for j in range(6) if j in (i % 6, (i + 1) % 6)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    plan = mixing.Plan(rounds=8, within=0.0)
    shares = lambda: {(r.source, r.lang): r.share for r in mixing.rake(cells, plan).collect()}
    with pytest.warns(UserWarning, match="after 8 rounds"):
        few = shares()
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    with pytest.warns(UserWarning, match="after 8 rounds"):
        many = shares()
    assert many == pytest.approx(few, rel=1e-9)


def test_mixing_odd_tables(spark):
    schema = "doc_id long, text string, source string, lang string"
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None), (1, "", "s", None), (1, "", "s", None), (2, "a", "s", "en")]
    assert mixing.mixed(spark.createDataFrame(rows, schema)).count() == 4


def test_columns_with_the_names_of_ours(spark):
    """Repeated ids, clashing names, ties between centres."""
    rows = [(1, "a b", "s", "en"), (1, "a b", "s", "en"), (2, "", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({k: F.lit("x") for k in ("cell", "mix", "topic", "prob", "share", "tokens")})
    out = mixing.mixed(df)
    assert out.columns[:-1] == df.columns and out.count() == 3
    tie = mixing.Topics(((0.0,) * 6, (2.0,) * 6), (1.0,) * 6)
    near = spark.range(1).select(*[F.lit(1).cast("bigint").alias(f"x{i}") for i in range(6)]).select(tie.nearest([F.col(f"x{i}") for i in range(6)])).first()[0]
    assert near == 0


def test_topics_are_learned_from_all_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOPIC_SAMPLE", 10, raising=False)
    texts = ["x" * 40 + str(10**i) * (i + 1) for i in range(15)] * 20 + ["a b C\n"] * 7 + [None]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    met, learn = [], mixing.learn_topics
    monkeypatch.setattr(mixing, "learn_topics", lambda *how: met.append(learn(*how)) or met[-1])
    got = mixing.mixed(docs).select("doc_id", "mix.topic").collect()
    numbers = np.array([tuple(r) for r in docs.where("text is not null").select(*mixing.profile()).collect()], float)
    assert np.allclose(met[0].scale, np.maximum(1.0, numbers.var(axis=0)) ** 0.5)
    centres, known = np.array(met[0].centres), [int(r.topic[6:]) for r in sorted(got)][: len(numbers)]
    assert all(np.allclose(centres[k], numbers[np.array(known) == k].mean(axis=0)) for k in set(known))
