"""The operators against plain versions, on small tables of odd cases and on the smallest given tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import BASE, LOW, SPACE, WORD, by_row, documents, texts
from pyspark.sql import functions as F

from orefield.llm import automaton, decontamination, fmindex, licenses, media, mixing, neardups, quality, secrets, sharding, substrings, warc
from orefield.llm.common import maybe_in, table


def given(spark, data):
    return [(r.doc_id, r.text) for r in table(spark, data, "documents").select("doc_id", "text").collect()]


# mixing


def test_targets_are_met_and_no_document_is_over_its_limit(spark):
    docs = documents(spark)
    got = mixing.mix(docs, shapes=mixing.CURRICULUM).toPandas()
    assert len(got) == len(texts())
    sizes = Counter()
    for (i, t), s in zip(texts(), [docs_source for docs_source in ["a", "b", None, "é"] * 6], strict=False):
        sizes[s] += len(SPACE.findall(t or ""))
    assert sorted(set(got.source_size)) == sorted(set(sizes.values()))
    assert (got.taken <= 3 * got["size"]).all()
    for _, part in got.groupby("source_size"):
        assert abs(part.taken.sum() - part.target.iloc[0]) < 1
    assert got.target.groupby(got.source_size).first().sum() == pytest.approx(sum(sizes.values()))
    assert got.position.dropna().is_monotonic_increasing
    again = mixing.mix(docs, shapes=mixing.CURRICULUM).toPandas()
    order = ["doc_id", "size", "taken", "position"]
    assert got[order].sort_values(order).reset_index(drop=True).equals(again[order].sort_values(order).reset_index(drop=True))


def test_positions_and_copies_against_a_plain_version(spark):
    docs = documents(spark)
    shapes = [mixing.FALLING, ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (1.0, 1.0))]
    got = mixing.mix(docs, shapes=shapes).collect()
    rows = mixing.sized(docs).select("doc_id", "key", "order", "size").collect()
    target = {r.source_size: r.target for r in got}
    want = Counter()
    whole = sum(r["size"] for r in rows)
    for rank, key in enumerate(sorted({r.key for r in rows})):
        own = sorted((r for r in rows if r.key == key), key=lambda r: (r.order, r.doc_id is not None, r.doc_id or 0, r["size"]))
        words = sum(r["size"] for r in own)
        goal, start = int(target[words]), 0
        knots = np.linspace(0, 1, 200001)
        height = np.interp(knots, *zip(*shapes[rank % 2]))
        share = np.concatenate([[0], np.cumsum((height[1:] + height[:-1]) / 2)])
        for r in own:
            reads = [(k * words + start, min(r["size"], max(0, goal - k * words - start))) for k in range(4)]
            taken = sum(n for _, n in reads)
            copies = sum(2 * n >= r["size"] and n > 0 for _, n in reads) if r["size"] else goal // words  # nothing in them to cut
            position = round(float(np.interp(start / goal, share / share[-1], knots)) * whole) if taken else None
            want[r.doc_id, r["size"], taken, copies, position] += 1
            start += r["size"]
    near = Counter((r.doc_id, r["size"], r.taken, r.copies, r.position) for r in got)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for a, b in zip(sorted(near.elements(), key=key), sorted(want.elements(), key=key), strict=True):
        assert a[:4] == b[:4] and (a[4] is None) == (b[4] is None) and (a[4] is None or abs(a[4] - b[4]) <= 2)


def test_one_id_is_spread_over_the_order(spark):
    rows = documents(spark, [(None, f"text number {k}") for k in range(500)] + [(7, f"text number {k}") for k in range(500)])
    assert mixing.sized(rows).select("order").distinct().count() == 1000


def test_targets_are_capped_and_reshared(spark):
    sizes = {"sa": 100, "sb": 10, "sc": 5, "z": 1000}
    got = {r.key: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "key string, source_size long"), (1, 2, 3), 3.0).collect()}
    weights, limit, want, left = dict(zip(sorted(sizes), (1, 2, 3, 1))), {k: 3 * v for k, v in sizes.items()}, {}, sum(sizes.values())
    open_ = set(sizes)
    while open_:
        share = {k: left * weights[k] / sum(weights[o] for o in open_) for k in open_}
        over = {k for k in open_ if share[k] > limit[k]}
        if not over:
            want |= share
            break
        for k in over:
            want[k] = limit[k]
            left -= limit[k]
        open_ -= over
    assert got == pytest.approx(want)


def test_time_inverts_the_schedule(spark):
    shape = ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (1.0, 1.0))
    knots = np.linspace(0, 1, 20001)
    height = np.interp(knots, *zip(*shape))
    share = np.concatenate([[0], np.cumsum((height[1:] + height[:-1]) / 2)])
    share /= share[-1]
    rows = spark.range(0, 101).select((F.col("id") / 100).alias("u")).select("u", mixing.time_of(F.col("u"), mixing.segments(shape)).alias("t")).collect()
    for r in rows:
        assert np.interp(r.t, knots, share) == pytest.approx(r.u, abs=1e-4)


def test_mixed_documents_keep_columns_and_copies(spark):
    docs = documents(spark)
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id] += r.copies
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    words = {i for i, t in texts() if SPACE.findall(t or "")}
    count = Counter(r.doc_id for r in got.collect())
    assert {i: c for i, c in count.items() if i in words and i is not None} == {i: c for i, c in plan.items() if c and i in words and i is not None}


# sharding


def test_shards_are_even_and_slots_have_no_gaps(spark, data):
    docs = table(spark, data, "documents")
    got = sharding.shard(docs, 6).toPandas()
    assert len(got) == docs.count()
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() < 0.3 * load.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_shards_of_odd_cases(spark):
    got = sharding.shard(documents(spark), 3).toPandas()
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 8 for _, t in texts())
    assert sorted(got.text_crc32) == sorted(zlib.crc32((t or "").encode()) for _, t in texts())
    again = sharding.shard(documents(spark), 3).toPandas()
    key = ["doc_id", "size", "shard", "slot"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_a_hot_text_is_spread(spark):
    rows = [(k, "hot text") for k in range(600)] + [(600 + k, f"text {k} " * 3) for k in range(300)]
    got = sharding.shard(documents(spark, rows), 5).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= 0.1 * load.mean()
    docs = sharding.sharded_documents(documents(spark, rows), 5)
    assert docs.columns == ["size_input" if c == "size" else c for c in documents(spark).columns] + ["size", "shard", "slot"] and docs.count() == 900
    assert {r.size_input for r in docs.collect()} == {7}


def plain_shards(rows, shards):
    """The law in words: equal steps of the running bytes in the order of (hash of the text, doc_id); a cut inside a group of equal
    texts of up to a sixteenth of a shard moves to the group's nearer end; a row goes where its middle is."""
    order = sorted(rows, key=lambda r: (r.h, r.d, r.size))
    total, at, starts = sum(r.size for r in rows), 0, []
    for r in order:
        starts.append(at)
        at += r.size
    ideal, edges = total / shards, []
    for k in range(1, shards):
        m = ideal * k
        inside = next((n for n, (r, s) in enumerate(zip(order, starts)) if s < m < s + r.size), None)
        if inside is not None:
            group = [n for n, r in enumerate(order) if r.h == order[inside].h]
            lo, hi = starts[group[0]], starts[group[-1]] + order[group[-1]].size
            if hi - lo <= ideal / 16 and lo < m < hi:
                edges.append(lo if m - lo < hi - m else hi)
                continue
        edges.append(round(m))
    out, slots = [], Counter()
    for r, s in zip(order, starts):
        shard = sum(e <= s + r.size / 2 for e in edges)
        out.append((r.doc_id, r.size, shard, slots[shard]))
        slots[shard] += 1
    return out


def test_shards_against_a_plain_version(spark, data):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    hot = documents(spark, [(k, "hot text") for k in range(600)] + [(600 + k, f"text {k % 50} " * 3) for k in range(900)])
    for docs, shards in ((table(spark, data, "documents"), 24), (documents(spark), 3), (hot, 7)):
        rows = sharding.keyed(docs).collect()
        got = [(r.doc_id, r.size, r.shard, r.slot) for r in sharding.shard(docs, shards).collect()]
        assert sorted(got, key=key) == sorted(plain_shards(rows, shards), key=key)


def test_shards_of_other_ids(spark):
    rows = spark.createDataFrame([("abc", "text"), ("12", "text"), (None, "text"), ("abc", None)], "doc_id string, text string")
    got = sharding.shard(rows, 2).collect()
    assert len(got) == 4 and {r.doc_id for r in got} == {"abc", "12", None}


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """A first sample that sees nothing of a dense stretch: later rounds divide it, so no range is far over the mean."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    rows = sharding.keyed(documents(spark, [(k, f"text {k}") for k in range(4000)] + [(5000 + k, "hot") for k in range(4000)])).cache()
    bounds, _ = sharding.splitters(rows, 16)
    sizes = [r["count"] for r in rows.groupBy(sharding.lookup(bounds, F.col("h"), F.col("d"))).count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 2.5 * 100


def test_lookup_counts_boundaries(spark):
    bounds = [(k * 10, k) for k in range(13)]
    rows = spark.createDataFrame([(h, d) for h in range(-5, 130, 5) for d in (0, 3, 20)], "h long, d long")
    for r in rows.select("h", "d", sharding.lookup(bounds, F.col("h"), F.col("d")).alias("n")).collect():
        assert r.n == sum(b <= (r.h, r.d) for b in bounds)


# decontamination


def plain_hits(rows, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(str(item))
    sizes = {len(p) for p in windows}
    out = []
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        hit, found = [False] * len(w), set()
        for k in range(len(w)):
            for n in sizes:
                if found_here := windows.get(tuple(w[k : k + n])) if k + n <= len(w) else None:
                    found |= found_here
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return out


def check_hits(spark, docs, rows, items):
    got = decontamination.scan(docs, spark.createDataFrame(items, "item_id long, text string"))
    have = [tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r[:4])
    assert sorted(have, key=key) == sorted(plain_hits(rows, items), key=key)


def test_benchmark_hits(spark, data):
    items = [(10, " ".join(BASE[20:45])), (9, "Same, ROW"), (11, "one"), (12, None), (13, ""), (14, "pass1 pass2 pass3 pass4 pass5 pass6 pass7 pass8 pass9 pass10 pass11 elsewhere"), (15, "a b a b"), (15, "zz yy")]
    check_hits(spark, documents(spark), texts(), items)
    check_hits(spark, documents(spark), texts(), [])
    rows = given(spark, data)
    check_hits(spark, table(spark, data, "documents"), rows, [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()])


@pytest.mark.parametrize("vocabulary", [1 << 20, 300])
def test_benchmark_in_blocks(spark, data, monkeypatch, vocabulary):
    monkeypatch.setattr(decontamination.phrase_blocks, "__defaults__", (10, 2000))
    monkeypatch.setattr(decontamination, "VOCABULARY", vocabulary)
    check_hits(spark, table(spark, data, "documents"), given(spark, data), [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()])


def test_fm_index():
    rng = np.random.default_rng(4)
    for top in (1, 2, 5, 40):
        s = np.append(rng.integers(0, top + 1, 700), 0)
        index = fmindex.FMIndex(s, top)
        for size in (1, 2, 4):
            patterns = rng.integers(1, top + 1, (30, size))
            lo, hi = index.search(patterns)
            for p, a, b in zip(patterns, lo, hi, strict=True):
                want = [k for k in range(s.size - size + 1) if (s[k : k + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# secrets


def test_secrets(spark, data):
    rules = [(k, re.compile(p, re.I | re.A if c else re.A), n) for k, p, c, n in secrets.RULES]

    def plain(text):
        found = []
        for n, (kind, rule, least) in enumerate(rules):
            rule = re.compile("[0-9a-f]+") if kind == "hex" else rule
            found += [(m.start(), n, m.end()) for m in rule.finditer(text or "") if len(m[0]) >= least and (kind != "assign" or len(m[2]) >= 12)]
        return ",".join(f"{rules[n][0]}:{s}:{e}" for s, n, e in sorted(found))

    for docs, rows in ((documents(spark), texts()), (table(spark, data, "documents"), given(spark, data))):
        got = secrets.scan(docs).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.spans) for r in got) == sorted((i is None, i or 0, plain(t)) for i, t in rows)
    r = next(r for r in secrets.scan(documents(spark)).collect() if r.doc_id == 15)
    assert (r.n_assign, r.n_access, r.n_hex) == (2, 1, 1)
    assert r.base_sha256 == hashlib.sha256(",".join(s for s in r.spans.split(",") if s.split(":")[0] in secrets.BASE).encode()).hexdigest()


def test_automaton_against_re():
    rng = np.random.default_rng(5)
    patterns = ["ab*c", "(a|bc)+d?", "[a-c]{2,3}d", "a{3}", "x|yz"]
    trees = [automaton.Syntax(p).parse() for p in patterns]
    whole = automaton.compile_rules(trees, search=True)
    for _ in range(50):
        text = "".join(rng.choice(list("abcdxyz"), 200))
        bits = automaton.lanes(whole, np.frombuffer(text.encode(), np.uint8), width=7)
        for n, p in enumerate(patterns):
            ends = {k for k in range(1, 201) if any(re.fullmatch(p, text[j:k]) for j in range(max(0, k - 40), k))}
            assert {int(k) + 1 for k in np.flatnonzero(bits >> n & 1)} >= ends
            assert all(any(re.fullmatch(p, text[j:k]) for j in range(k)) for k in (int(k) + 1 for k in np.flatnonzero(bits >> n & 1)))


# media


def test_media(spark):
    rows, folder = media.stored(documents(spark).repartition(5), shard_bytes=4096)
    assert rows.select("shard", "at").distinct().count() == rows.select("digest").distinct().count()
    got = by_row(media.read_back(rows, folder))
    assert len(got) == len(texts())
    values = {}
    for r in got:
        values.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["payload_bytes"]))
    assert all(len(v) == 1 for v in values.values())
    want = Counter()
    for _, t in texts():
        body = (t or "").encode()
        payload = body + bytes(-len(body) % 64 or (0 if body else 64))
        want[len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    headers = by_row(media.read_back(rows, folder, samples=False))
    assert Counter((r["width"], r["height"]) for r in headers) == Counter((64, r["payload_bytes"] // 64) for r in got)


def test_image_round_trip_in_chunks(monkeypatch):
    monkeypatch.setattr(media, "CHUNK", 100)
    payload = bytes(np.random.default_rng(6).integers(0, 256, 6400, dtype=np.uint8))
    image = media.encode(payload)
    assert media.decode(image) == payload
    with pytest.raises(ValueError):
        media.decode(image[:60] + bytes([image[60] ^ 1]) + image[61:])


# archives


def test_archives(spark):
    big = "x" * 1200
    rows = [(1, "http://a.example/b", big), (2, "http://a.example/b", big), (3, None, big), (4, "http://www.A.example/?b=2&a=1", "small"), (5, "bad url [", "small"), (6, "http://z.example", None), (7, "http://é.example/\n", ""), (8, "u", "é" * 600), (8, "u", "é" * 600), (None, "n", "n"), (None, "m", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive(pages).collect()
    assert [(r.url_key, r.captured, r.page_id or 0) for r in got] == sorted((r.url_key, r.captured, r.page_id or 0) for r in got)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == body and j is not None]
        ref = max(same) if len(body) >= 1000 and max(same) != i else None
        want.append((i or 0, len(body), hashlib.sha1(body).hexdigest(), "response" if ref is None else "revisit", ref or 0))
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == sorted(want)
    assert warc.archive(pages.where("false")).count() == 0


def test_times_keep_the_order_of_ids():
    ids = [-(1 << 62), -5, None, 1, 1 << 31, (1 << 31) + 1, 1 << 40, 1 << 62]
    times = [warc.timestamp(i) for i in ids]
    assert times == sorted(times) and len({len(t) for t in times}) == 1 and warc.timestamp(1 << 31) < warc.timestamp((1 << 31) + 1)


def test_captures_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    pages = spark.range(0, 1000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".example/x")).alias("url"), F.lit("same").alias("html"))
    got = warc.archive(pages, 5).collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and len(keys) == 1000


def test_loser_tree():
    rng = np.random.default_rng(7)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.integers(0, 30, rng.integers(0, 20)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda v: (v,))) == sorted(sum(runs, []))


# quality


def test_quality_on_held_out_rows(spark, data):
    from orefield.llm.quality import op7_quality

    sf = data.replace("sf0.001", "sf0.01")
    got = op7_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    assert ((got.doc_id.astype(str).map(lambda s: zlib.crc32(s.encode()) % 3) == 1) == got.held_out).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_of_odd_cases(spark, data):
    labels = table(spark, data, "labels")
    machine = quality.learned(table(spark, data, "documents"), labels)
    got = quality.scored(documents(spark), machine)
    assert got.count() == len(texts()) and got.columns == [c for c in documents(spark).columns if c != "score"] + ["score"]
    one_class = quality.learned(table(spark, data, "documents"), labels.where("quality = 1"))
    scores = {r.score for r in quality.scored(documents(spark), one_class).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1
    assert quality.scored(documents(spark, []), machine).count() == 0


def test_one_id_that_many_documents_share(spark, monkeypatch):
    """100000 texts of one labelled id: the driver sees the bound."""
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda words, stats, labels: seen.append(len(words)) or fit(words, stats, labels, rounds=1))
    docs = spark.range(0, 100000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    quality.learned(docs.union(docs), labels, most=500)
    quality.learned(docs.withColumn("text", F.lit("same")), labels, most=500)
    assert 400 < seen[0] < 600 and seen[1] == 1


def test_scores_against_plain_sums(spark, data):
    docs = table(spark, data, "documents")
    m = quality.learned(docs, table(spark, data, "labels"))
    got = {r.doc_id: r.score for r in quality.scored(docs, m).select("doc_id", "score").collect()}
    for i, text in given(spark, data)[:40]:
        words, stats = quality.features(text or "")
        x = {int(b): 1 / np.sqrt(len(words)) for b in words} | {quality.BUCKETS + k * quality.BINS + int(sum(e <= s for e in m.edges[k])): 1.0 for k, s in enumerate(stats)}
        ids = sorted(x)
        z = m.bias + sum(m.w[a] * x[a] for a in ids) + sum(float(m.v[a] @ m.v[b]) * x[a] * x[b] for n, a in enumerate(ids) for b in ids[:n])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_pair_terms_by_the_identity():
    rng = np.random.default_rng(8)
    m = quality.Machine(np.zeros((quality.N_STATS, 15)), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    ids, x = np.array([1, 5, 7, 2, 9]), rng.normal(size=5)
    z = m.raw(ids, x, np.array([0, 3]))[0]
    for part, got in ((slice(0, 3), z[0]), (slice(3, 5), z[1])):
        i, v = ids[part], x[part]
        pairs = sum(m.v[i[a]] @ m.v[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert got == pytest.approx(0.3 + m.w[i] @ v + pairs)


# substrings


def plain_removed(rows, width=35):
    words = [SPACE.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i is None, i or 0, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("cells", [None, 64])
def test_repeated_passages(spark, data, cells):
    """Also with a sketch so small that it lets all through."""
    for docs, rows in ((documents(spark), texts()), (table(spark, data, "documents"), given(spark, data))):
        got = substrings.removed(docs, sketch_cells=cells).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_removed(rows)


@pytest.mark.parametrize("remembered", [0, 50, 1 << 21])
def test_windows_that_a_task_meets_again(spark, monkeypatch, remembered):
    """Many shards a task, windows common to all shards, to all tasks, to one task, and twice in one shard."""
    monkeypatch.setattr(substrings, "SHARD_WORDS", 200)
    monkeypatch.setattr(substrings, "GATHERED", 300)
    monkeypatch.setattr(substrings, "TASK_WINDOWS", remembered)
    line = [f"common{k}" for k in range(60)]
    rows = [(k, " ".join([*(f"a{k}x{j}" for j in range(40)), *line, *(f"task{k // 30}x{j}" for j in range(50)), *(f"b{k}x{j}" for j in range(40 if k % 3 else 80)), *([f"b{k}x{j}" for j in range(40)] if k % 5 == 0 else [])])) for k in range(90)]
    docs = documents(spark, rows).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").cache()
    got = substrings.removed(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_removed(rows)


def test_documents_dealt_anew_are_an_error(spark, monkeypatch):
    docs = documents(spark, [(k, " ".join(f"w{k}x{j}" for j in range(50))) for k in range(40)])
    made = substrings.sketched(docs.repartitionByRange(4, "doc_id"), 1 << 20, 1, 35, 18)
    with pytest.raises(Exception, match="dealt in another way"):
        substrings.looked_up(docs.repartitionByRange(4, F.col("doc_id").desc()).select("doc_id", "text"), made, 64, 35, 18)


def test_sliding_and_anchors():
    x = np.random.default_rng(9).integers(0, 50, 200).astype(np.uint64)
    for size in (1, 2, 3, 17, 18, 64):
        assert substrings.sliding(x, size, np.minimum).tolist() == [x[k : k + size].min() for k in range(200 - size + 1)]


# near duplicates


def plain_components(rows, shingle=3, percent=85):
    """Rows of equal id and text are one document."""
    sets = []
    for i, t in rows:
        w = SPACE.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [x for x in least[find(k)] if x is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None))
    return out


def same_components(got, rows, **how):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(plain_components(rows, **how), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates(spark, data):
    same_components(neardups.deduplicated(documents(spark)).collect(), texts())
    same_components(neardups.deduplicated(table(spark, data, "documents")).collect(), given(spark, data))
    assert neardups.deduplicated(documents(spark, [])).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(10)
    rows = []
    for k in range(400):
        w = list(BASE)
        for at in rng.integers(0, 80, rng.integers(0, 6)):
            w[at] = f"edit{rng.integers(0, 1000)}"
        rows.append((k, " ".join(w)))
    same_components(neardups.deduplicated(documents(spark, rows)).collect(), rows)
    same_components(neardups.deduplicated(documents(spark, rows), 5, 80).collect(), rows, shingle=5, percent=80)


def family_of(n, seed=11):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        w = list(BASE)
        for at in rng.integers(0, 80, rng.integers(0, 6)):
            w[at] = f"edit{rng.integers(0, 100000)}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("settings", [{"BLOCK": 5000, "HOT": 1000}, {"SETS_PER_CHUNK": 150, "HOT": 20}])
def test_families_cut_into_blocks_and_hot_keys(spark, monkeypatch, settings):
    for name, v in settings.items():
        monkeypatch.setattr(neardups, name, v)
    rows = family_of(400)
    same_components(neardups.deduplicated(documents(spark, rows)).collect(), rows)


def test_work_on_a_family_follows_its_members(spark):
    """Edges a member and rows a member, from 500 to 8000 near copies."""
    layout, edges = neardups.Layout(85), {}
    for n in (500, 2000, 8000):
        sets = {s.tobytes(): s for _, t in family_of(n) for s in [neardups.shingles(t, 3)]}
        e = neardups.entries_of(np.arange(len(sets)), neardups.signatures(list(sets.values()), layout), layout)
        edges[n] = len(neardups.family_edges(e, layout.matching)) / len(sets)
    assert edges[8000] < 1.5 * edges[500] and edges[8000] < 12
    members = spark.range(0, 5000).select((F.col("id") % 2).alias("family"), F.col("id").alias("sid"), F.lit(bytes(8 * 30)).alias("body"))
    assert neardups.dealt(members).count() == 5000


def test_recall_near_the_threshold(spark):
    """2000 pairs of a similarity of 0.85 to 0.90, each a component of its own."""
    rng, rows, want = np.random.default_rng(12), [], 0
    for k in range(2000):
        words = [f"w{k}x{j}" for j in range(int(rng.integers(60, 200)))]
        n = len(words) - 2
        fewest, most = np.ceil(n * 0.1 / 1.9), np.floor(n * 0.15 / 1.85)
        cut = int(rng.integers(fewest, most + 1))
        other = words[: len(words) - cut] + [f"v{k}x{j}" for j in range(cut)]
        a, b = (neardups.shingles(" ".join(w), 3) for w in (words, other))
        shared = np.intersect1d(a, b).size
        if not 0.85 <= shared / (a.size + b.size - shared) <= 0.9:
            continue
        want += 1
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    assert want > 1500
    got = neardups.deduplicated(documents(spark, rows)).where("not kept").count()
    assert got >= 0.99 * want


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in neardups.components(edges).collect()}
    assert all(got[k] == 0 for k in range(41)) and {got[k] for k in range(100, 104)} == {100}


def test_one_of_each(spark):
    kept = neardups.one_of_each(documents(spark)).collect()
    assert all(r._maybe and r["size"] == 7 and r.score == 0.5 for r in kept)
    ids = Counter(r.doc_id for r in kept)
    assert ids[7] == 1 and ids[8] == ids[9] == 0 and ids[0] == ids[1] == ids[2] == 1 and ids[None] == 2
    assert sorted(r.text for r in kept if r.doc_id == 12) == ["same id, other text", "same row"]
    assert ids[3] + ids[4] == 1


def test_bitmap_loses_nothing(spark):
    keys = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    rows = maybe_in(spark.range(0, 5000).withColumnRenamed("id", "k"), keys, "k", bits=16).collect()
    assert all(r._maybe for r in rows if r.k < 1000 and r.k % 7 == 0)
    assert sum(r._maybe for r in rows) < 300


# licenses


def test_licenses(spark, data):
    def plain(text):
        w = WORD.findall((text or "").translate(LOW))
        found = [(k, name) for name, phrase in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        low = WORD.findall((text or "").lower())
        best = 0.0
        more = set()
        for name, notice in licenses.NOTICES.items():
            want = set(licenses.tokens(notice))
            size = len(licenses.tokens(notice))
            if len(want) < licenses.SHORT:
                run = licenses.tokens(notice)
                share = float(any(w[k : k + size] == run for k in range(len(w))))
            else:
                step = max([licenses.STEP, *(n for v in licenses.NOTICES.values() if ((n := len(licenses.tokens(v))) > licenses.STEP) == (size > licenses.STEP))])
                share = max((len(set(low[s : s + 2 * step]) & want) / len(want) for s in range(0, max(1, len(low)), step)), default=0.0)
            if share >= licenses.THRESHOLD - 1e-9:
                more.add(name)
                best = max(best, share)
        places, base = [k for k, _ in found], {n for _, n in found}
        return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else best)

    extra = [(100 + n, f"before {v} after") for n, v in enumerate(licenses.NOTICES.values())] + [(200, licenses.NOTICES["mit-notice"][:-40]), (201, "mit license mit license")]
    for docs, rows in ((documents(spark, texts() + extra), texts() + extra), (table(spark, data, "documents"), given(spark, data))):
        got = licenses.scan(docs).collect()
        key = lambda r: tuple((x is None, x or 0) for x in r)
        have = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got), key=lambda r: key(r[:3]))
        want = sorted(((i, *plain(t)) for i, t in rows), key=lambda r: key(r[:3]))
        assert have == want


# all of them, over nothing


def test_empty_tables(spark, data):
    none = documents(spark, [])
    items = table(spark, data, "benchmark")
    for got in (mixing.mix(none), mixing.mixed_documents(none), sharding.shard(none), sharding.sharded_documents(none), decontamination.scan(none, items), secrets.scan(none), media.read_back(*media.stored(none)), substrings.removed(none), neardups.one_of_each(none), licenses.scan(none)):
        assert got.count() == 0
