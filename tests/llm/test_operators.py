"""The text operators against brute force on small tables full of edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import byte_bpe, common, exact_dedup, host_rules, line_crf, line_dedup, mixing, ngram_jaccard, token_rollups, toxicity, training_order
from lattica.llm.components import components
from lattica.llm.npbytes import blocks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double, ids string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=120):
    """Texts with copies, near copies, shared lines and passages, odd characters; columns that clash with results."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared, passage = [line(8) for _ in range(4)], line(60)
    texts = [None, "", " \t ", "\n\n", "one", "A b", "a B", "x " * 3000, "'s 'll don't  we've\t\n '", "É" + line(9), "é" + line(9), "ΣΑΣ İ K " + line(8)]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.15 and texts[-1]:
            texts.append(rng.choice([t for t in texts if t]).swapcase() if kind < 0.05 else rng.choice(texts))
        elif kind < 0.35:
            words = (rng.choice([t for t in texts if t and len(t) > 200] or [passage])).split(" ")
            words[rng.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
        elif kind < 0.6:
            texts.append("\n".join([line(rng.randint(1, 30)), "  " + rng.choice(shared).upper() + "\t", line(5), rng.choice(shared)]))
        elif kind < 0.7:
            texts.append(line(5) + " " + passage)
        else:
            texts.append("\n".join(line(rng.randint(0, 40)) for _ in range(rng.randint(1, 6))))
    rows = [(i * 3 - 5, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", "Z", None]), 1, -1, None, 0.5, "clash") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3, "doc_id").persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing_meets_targets(docs, empty):
    got = mixing.mix(docs).collect()
    sizes, weights = Counter(), {}
    for r in corpus():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = (5, 2, 1)[k % 3]
    budget, open_, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        v = (budget - sum(target.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * v > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: weights[s] * v for s in open_}
        open_ = open_ - full if full else set()
    assert len(got) == len(corpus())
    taken, longest = Counter(), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert target[s] - longest[s] - 1 <= taken[s] <= target[s] + longest[s]
    assert sorted(mixing.mix(docs.repartition(7)).collect(), key=str) == sorted(got, key=str)
    assert mixing.mix(empty).count() == 0
    copies = {r["doc_id"]: r["copies"] for r in got if r["copies"]}
    rows = mixing.mixture(docs)
    assert rows.columns == docs.columns
    assert Counter(r["doc_id"] for r in rows.collect()) == copies


def test_mixing_of_wordless_and_repeated_rows(spark):
    blank = spark.createDataFrame([(1, "", "a"), (1, "", "a"), (None, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0, 0]
    twice = spark.createDataFrame([(1, "x y", "a")] * 6, "doc_id long, text string, source string")
    got = mixing.mix(twice).collect()
    assert len(got) == 6 and sum(r["taken"] for r in got) <= 18


def test_host_rules(spark, docs, empty):
    got = {r["doc_id"]: r for r in host_rules.judge(docs).collect()}
    for i, t, *_ in corpus():
        words = WORD.findall(t or "")
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        times = Counter(windows)
        repeated = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert host_rules.judge(empty).count() == 0
    # a host that mostly fails takes its good documents along; a host with one failure in many does not
    good, bad = " ".join(f"word{k}" for k in range(30)), "too short"
    rows = [(k, bad if k % 10 else good, "bad") for k in range(100)] + [(100 + k, good if k else bad, "fine") for k in range(100)]
    host = host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["source"]: r["n"] for r in host.where("kept").groupBy("source").agg(F.count("*").alias("n")).collect()} == {"fine": 99}


def brute_lines(rows):
    keys = {}
    for i, t, *_ in rows:
        keys[i] = [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (t or "").split("\n")]
    holders = defaultdict(set)
    for i, own in keys.items():
        for k in own:
            if len(k) >= 20:
                holders[k].add(i)
    out = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, keys[i], strict=True) if len(holders.get(k, ())) < 3 or i == max(holders[k])]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


@pytest.mark.parametrize("bits", [line_dedup.MAX_BITS, 1 << 10])
def test_line_dedup(docs, empty, bits):
    """Also with a filter far too small, which must not change the result."""
    out = line_dedup.dedup_lines(docs, max_bits=bits)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()} == brute_lines(corpus())
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sum(v[1] for v in brute_lines(corpus()).values()) > 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_partial_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 1 << 63, 400, dtype=np.uint64) for _ in range(3)]
    parts[1][:50], parts[2][:20] = parts[0][:50], parts[0][100:120]
    once, twice = np.zeros(1 << 13, np.uint8), np.zeros(1 << 13, np.uint8)
    for p in parts:
        f = line_dedup.Filters(1 << 16)
        f.add(p)
        a, b = (line_dedup.unpack(line_dedup.pack(x), 1 << 13) for x in (f.once, f.twice))
        twice |= b | (once & a)
        once |= a
    f = line_dedup.Filters(1 << 16)
    hit = f.holds(twice, f.places(np.concatenate((parts[0][:50], parts[0][100:120]))))
    assert hit.all()


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[(t or "").translate(LOWER)].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.dedup(docs).collect()}
    assert len(got) == len(corpus())
    for t, members in groups.items():
        for i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(members), len(members), i == max(members), hashlib.sha256(t.encode()).hexdigest())
    assert max(map(len, groups.values())) > 2
    assert exact_dedup.dedup(empty).count() == 0


def test_exact_dedup_tells_colliding_chunks_apart(spark):
    """With chunk hashes of 2 bits, different texts share recipes; contents must decide."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 3, 40, 3000]))) for _ in range(90)]
    texts = ["Aaaa", "aaab", "aaac", "aaad", "aaae", *texts, *[t.upper() for t in texts[:40]], "AAAA"]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.lower()].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hash_bits=2).collect()}
    assert len({(len(texts[i]), tuple(r["recipe"])) for i, r in got.items()}) < 0.75 * len(groups)
    assert {i: (r["keep_id"], r["group_size"]) for i, r in got.items()} == {i: (max(g), len(g)) for g in groups.values() for i in g}


def test_chunks_follow_content():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    one, two = exact_dedup.chunks(data), exact_dedup.chunks(b"some words before " + data)
    assert b"".join(b for _, b in two) == b"some words before " + data
    assert len({h for h, _ in one} & {h for h, _ in two}) > 0.8 * len(one)


@pytest.fixture(scope="module")
def own_codec():
    public = pytest.importorskip("public_tokenizers")
    return byte_bpe.codec(public.path("byte_bpe_50k.tiktoken")), public


def test_bpe_matches_the_library(spark, docs, empty, own_codec):
    import tiktoken

    codec, public = own_codec
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "a", "Z", "é", "22", "!", "　", "😀", "'d", "lll", "'S", "日本", "²", "\x85", "Ᲊ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000, "!" * 999, " " * 777, "", "don't stop"]
    got = []
    for first, end, data, offsets in blocks(pa.array(texts, pa.large_string()), 4096):
        ids, at = codec.encode(data, offsets)
        places = codec.offsets(ids, at)
        got += [ids[at[k] : at[k + 1]].tolist() for k in range(end - first)]
        assert codec.decode(ids).tobytes() == data.tobytes()
        for k in range(end - first):
            own = ids[at[k] : at[k + 1]]
            assert places[at[k] : at[k + 1]].tolist() == np.concatenate(([0], np.cumsum(codec.length[own])))[:-1].tolist()
    assert got == library.encode_ordinary_batch(texts)
    path = public.path("byte_bpe_50k.tiktoken")
    out = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), path), path).collect()
    assert {r["doc_id"]: (r["ids"], bytes(r["decoded"])) for r in out} == {i: (library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in corpus()}
    assert byte_bpe.encode(empty, path).count() == 0


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}, links


def test_ngram_jaccard(docs, empty):
    want, links = brute_components(corpus())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.join(docs).collect()}
    assert got == want
    assert len(links) > 20
    assert ngram_jaccard.join(empty).count() == 0


def near_copies(seed, n):
    """Texts at the threshold: chains of edits of one text, among them some that link with none."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{k}" for k in range(80)]
        for k in rng.sample(range(80), rng.choice([0, 1, 2, 3, 4, 6])):
            words[k] = f"e{rng.randint(0, 5)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("tile", "size"), [(1024, 8 << 20), (7, 8 << 20), (1024, 3000)])
def test_ngram_jaccard_of_near_copies_over_many_tiles(spark, monkeypatch, tile, size):
    monkeypatch.setattr(ngram_jaccard, "TILE", tile)
    monkeypatch.setattr(ngram_jaccard, "TILE_BYTES", size)
    rows = near_copies(4, 60)
    want, links = brute_components(rows)
    assert len(links) > 100
    assert len({c for _, c in want.values()}) > 3
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("tile", [1024, 7])
def test_ngram_jaccard_counts_every_link(spark, docs, empty, monkeypatch, tile):
    """Links inside near-copy groups and between copies, whatever the tiles."""
    monkeypatch.setattr(ngram_jaccard, "TILE", tile)
    rows = near_copies(5, 50)
    rows += [(100 + i, rows[i % 3][1].upper()) for i in range(6)] + [(200, "alone"), (201, ""), (202, None), (203, "")]
    for df, own in ((docs, corpus()), (spark.createDataFrame(rows, "doc_id long, text string"), rows)):
        want, links = brute_components(own)
        ends = Counter(x for pair in links for x in pair)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_jaccard.join(df, with_links=True).collect()}
        assert got == {i: (*v, ends[i]) for i, v in want.items()}
    assert max(ends.values()) > 10
    assert ngram_jaccard.join(empty, with_links=True).count() == 0


def test_ngram_jaccard_of_null_ids_repeated_rows_and_clashing_columns(spark):
    """Ids may be null or shared; every other column comes back whatever its name."""
    a, b, c = " ".join(map(str, range(40))), " ".join(map(str, range(39))), " ".join(map(str, range(100, 140)))
    rows = [(None, a), (5, a), (5, c), (3, b), (3, b), (None, c.upper()), (9, "x " * 200_000 + "y"), (None, "word"), (None, "word"), (None, ""), (1, None)]
    names = ["n", "m", "s1", "s2", "sig", "region", "bits", "bands", "label", "component", "node", "lead", "class_size", "__own", "a b.c"]
    df = spark.createDataFrame([(i, t, *[f"{k}{j}" for j in range(len(names))]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = sorted((r.asDict() for r in ngram_jaccard.join(df).collect()), key=lambda r: int(r["n"][:-1]))
    assert [(r["doc_id"], r["component_id"], r["class_size"]) for r in got] == [
        (None, 3, 2), (5, 3, 2), (5, 5, 2), (3, 3, 2), (3, 3, 2), (None, 5, 2), (9, 9, 1), (None, None, 2), (None, None, 2), (None, None, 1), (1, 1, 1)
    ]
    assert [r["a b.c"] for r in got] == [f"{k}14" for k in range(len(rows))]
    assert set(got[0]) == {*df.columns, "n_shingles", "component_id"} - {"text"}


def test_tile_finds_links_by_bitmaps_and_arrays():
    """The bound is never below the overlap, and what a tile finds is what sets say."""
    rng = np.random.default_rng(2)
    pool = rng.integers(-(1 << 62), 1 << 62, 60)
    sets = [np.sort(rng.choice(np.unique(pool), rng.integers(40, 60), replace=False)) for _ in range(80)]
    n = np.array([len(s) for s in sets])
    tile = ngram_jaccard.Tile(ngram_jaccard.lists(sets), n, np.ones(len(sets), bool))
    found = 0
    for a in range(len(sets)):
        others = np.delete(np.arange(len(sets)), a)
        want = [b for b in others.tolist() if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
        assert tile.linked(a, others).tolist() == want
        assert set(want) <= set(np.flatnonzero(tile.fits(a)).tolist())
        found += len(want)
    assert found > 50


def test_members_hold_every_key(spark):
    from hashlib import blake2b

    keys = [int.from_bytes(blake2b(str(k).encode(), digest_size=8).digest(), "little", signed=True) for k in range(5000)]
    filled = common.members(spark.createDataFrame([(k,) for k in keys[:2000]], "k long")).value
    got = common.is_member(filled, np.array(keys, np.int64))
    assert got[:2000].all()
    assert got[2000:].mean() < 0.05


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1050)] + [(5000, 4999), (4999, 5000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {k: 1000 for k in range(1001, 1050)} | {5000: 4999}


def test_toxicity_learns_words(spark):
    rng = random.Random(0)
    words = [f"plain{k}" for k in range(200)]
    texts, labels = [], []
    for k in range(400):
        own = [rng.choice(words) for _ in range(40)]
        if k % 4 == 0:
            own[rng.randrange(40)] = rng.choice(["nastiest", "nasties", "nasty"])
        texts.append(" ".join(own))
        labels.append(k % 4 == 0)
    model = toxicity.fit(texts[:300], np.array(labels[:300]))
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts[300:])] + [(900, None, None), (901, "", "xx")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(df, model, {None: 0.5, "en": 0.7}).collect()}
    assert np.mean([(got[k] >= 0.7) == labels[300 + k] for k in range(100)]) >= 0.95
    assert got[900] == got[901] and 0 <= got[900] <= 1
    assert toxicity.fit([], np.zeros(0)).constant == 0.0 and toxicity.fit(["a"], np.ones(1)).constant == 1.0


def test_toxicity_of_a_text_does_not_depend_on_the_next():
    model = toxicity.Model()
    model.embed *= 20
    model.prepare()
    texts = ["", "calm words", "nasty vile words", "", "one", "vile nasty", " ", "vile"]
    blob = [t.encode() for t in texts]
    ids, at = toxicity.word_buckets(np.frombuffer(b"".join(blob), np.uint8), np.cumsum([0, *map(len, blob)]))
    together, where = model.pooled(ids, at, places=True)
    alone = [model.pooled(ids[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))[0] for i in range(len(texts))]
    assert np.array_equal(together, np.array(alone))
    assert np.array_equal(model.pooled(ids, at), together) and not together[[0, 3, 6]].any()
    ends = at[1:] - toxicity.PAD
    assert all((spots < ends[:, None]).all() for spots in where)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    emit, first = rng.normal(size=9), np.array([0, 1, 5, 9])
    pair, begin = rng.normal(size=(2, 2)), rng.normal(size=2)
    good = line_crf.marginals(emit, first, pair, begin)
    for a, b in zip(first, first[1:], strict=False):
        total, hits = 0.0, np.zeros(b - a)
        for code in range(1 << (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            w = np.exp(begin[y[0]] + sum(e for e, v in zip(emit[a:b], y, strict=True) if v) + sum(pair[p, q] for p, q in zip(y, y[1:], strict=False)))
            total += w
            hits += w * np.array(y)
        assert np.allclose(good[a:b], hits / total)


def test_line_crf(spark):
    rng = random.Random(0)
    texts, labels = [], []
    for k in range(300):
        line = lambda: " ".join(rng.choice(["some", "good", "words", "here"]) + str(rng.randint(0, 99)) for _ in range(12)) + "."
        bad = k % 3 == 0
        texts.append("\n".join(line().upper().replace(" ", "!! ") if bad else line() for _ in range(rng.randint(1, 6))))
        labels.append(not bad)
    model = line_crf.fit(texts[:200], np.array(labels[:200]))
    df = spark.createDataFrame([(k, t, 9.9) for k, t in enumerate(texts[200:])] + [(900, None, 0.0), (901, "", 0.0), (902, "\n\n", 0.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in line_crf.classify(df, model, with_lines=True).collect()}
    assert np.mean([(got[k]["score"] >= 0.7) == labels[200 + k] for k in range(100)]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"]
    assert len(got[902]["line_scores"]) == 3


def test_training_order(spark, docs, empty, tmp_path):
    path = str(tmp_path / "shards")
    index = training_order.materialise(docs.select("doc_id", "text"), path, length=16, per_shard=32).collect()
    n = len(index)
    assert sorted(r["slot"] for r in index) == list(range(n)) == sorted(r["seq_index"] for r in index)
    assert all(training_order.invert(r["slot"], n) == r["seq_index"] for r in index)
    assert sum(r["n_tokens"] for r in index) == sum(len(WORD.findall(t or "")) + 1 for _, t, *_ in corpus())
    seqs = {(r["__rid"], r["__rno"]): bytes(r["record"]) for r in training_order.records(docs, length=16).collect()}
    read = list(training_order.read_slots(spark, path, 0, n, per_shard=32, length=16))
    for r in index:
        assert read[r["slot"]].tobytes() == seqs[r["doc_id"], r["seq_no"]]
    assert [x.tolist() for x in training_order.read_slots(spark, path, 30, 5, per_shard=32, length=16)] == [x.tolist() for x in read[30:35]]
    assert training_order.materialise(empty.select("doc_id", "text"), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1000])
def test_permutation_is_a_bijection(spark, n):
    got = training_order.permute(spark.range(n).withColumnRenamed("id", "i"), "i", "slot", n).collect()
    assert sorted(r["slot"] for r in got) == list(range(n))
    assert all(training_order.invert(r["slot"], n) == r["i"] for r in got)


def test_training_order_of_repeated_rows_and_own_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, [5, 6]), (1, [7]), (1, [5, 6]), (None, None)], "doc_id long, tokens array<int>")
    index = training_order.materialise(df, str(tmp_path / "s"), text_col=None, ids_col="tokens", length=4).collect()
    assert sorted(r["slot"] for r in index) == [0, 1, 2, 3]
    read = sorted(x.tolist() for x in training_order.read_slots(spark, str(tmp_path / "s"), 0, 4, length=4))
    assert read == [[1, 0, 0, 0], [7, 8, 1, 0], [7, 8, 1, 0], [9, 1, 0, 0]]


def test_training_order_of_bpe_ids_is_read_back_as_text(spark, docs, tmp_path, own_codec):
    """Shards of real token ids: every document is put together again from its slots."""
    codec, public = own_codec
    encoded = byte_bpe.encode(docs.select("doc_id", "text", F.lit("x").alias("slot")), public.path("byte_bpe_50k.tiktoken"))
    index = training_order.materialise(encoded, str(tmp_path / "s"), text_col=None, ids_col="ids", length=64, per_shard=16).collect()
    read = list(training_order.read_slots(spark, str(tmp_path / "s"), 0, len(index), per_shard=16, length=64))
    parts = defaultdict(list)
    for r in sorted(index, key=lambda r: (r["doc_id"], r["seq_no"])):
        parts[r["doc_id"]].append(read[r["slot"]][: r["n_tokens"]])
    got = {i: np.concatenate(p).astype(np.int64) for i, p in parts.items()}
    assert all(ids[-1] == 1 for ids in got.values())
    assert {i: codec.decode(ids[:-1] - training_order.SPECIAL).tobytes().decode() for i, ids in got.items()} == {i: t or "" for i, t, *_ in corpus()}


def test_edges_of_training_order(spark, edges, tmp_path):
    index = training_order.materialise(edges, str(tmp_path / "s"), length=128, per_shard=8).collect()
    counts = [len(WORD.findall(t or "")) + 1 for _, t, _ in edge_rows()]
    assert sorted(r["slot"] for r in index) == list(range(sum(-(-c // 128) for c in counts)))
    by_row = defaultdict(int)
    for r in index:
        by_row[r["n"]] += r["n_tokens"]
    assert sum(by_row.values()) == sum(counts)
    read = list(training_order.read_slots(spark, str(tmp_path / "s"), 0, len(index), per_shard=8, length=128))
    assert all(np.count_nonzero(read[r["slot"]]) == r["n_tokens"] for r in index)


def test_rollups_are_additive_and_idempotent(spark, tmp_path):
    make = lambda r: spark.createDataFrame(r, "doc_id long, source string, lang string, version string, n_tokens long, op string")
    s = token_rollups.Rollup(spark, str(tmp_path))
    assert s.totals().count() == 0
    assert s.commit(1, make([(1, "a", "en", "v", 10, "upsert"), (2, "a", "en", "v", 5, "upsert"), (3, None, None, "v", None, "upsert")]))
    assert not s.commit(1, make([(9, "a", "en", "v", 99, "upsert")]))
    s.commit(2, make([(1, "b", "en", "v", 12, "upsert"), (2, "a", "en", "v", None, "delete"), (7, "a", "en", "v", 1, "delete")]))
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in s.totals().collect()}
    assert got == {("b", "en"): (1, 12), (None, None): (1, 0)}
    s.commit(3, make([]))
    assert {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in s.totals().collect()} == got
    with pytest.raises(ValueError, match="older"):
        s.commit(0, make([]))


def test_rollups_follow_a_plain_dictionary_through_compactions(spark, tmp_path, monkeypatch):
    """Ties, repeated rows, null ids and clashing columns, over many batches; the ledger is folded on the way."""
    monkeypatch.setattr(token_rollups, "COMPACT_EVERY", 3)
    rng, held, store = random.Random(8), {}, token_rollups.Rollup(spark, str(tmp_path))
    for batch in range(7):
        rows = [(rng.choice([None, *range(12)]), rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["v", "w"]), rng.choice([None, 1, 5, 9]), rng.choice(["upsert", "upsert", "delete"]), rng.randint(0, 3), 7, "x") for _ in range(20)]
        rows += rows[:3]
        df = spark.createDataFrame(rows, "doc_id long, source string, lang string, version string, n_tokens long, op string, seq long, bucket int, tokens string")
        assert store.commit(batch, df)
        last = {}
        for i, source, lang, version, n, op, seq, *_ in rows:
            up = op != "delete"
            # nulls are least, as in Spark
            rank = (seq, up, (n or 0) if up else -1, source is not None, source or "", lang is not None, lang or "")
            if rank >= last.get((i, version), ((-1,),))[0]:
                last[i, version] = (rank, (source, lang, version, n or 0) if up else None)
        for k, (_, row) in last.items():
            held[k] = row
            if row is None:
                del held[k]
        want = Counter()
        for source, lang, version, n in held.values():
            want[source, lang, version, "docs"] += 1
            want[source, lang, version, "tokens"] += n
        got = Counter()
        for r in store.totals().collect():
            got[r["source"], r["lang"], r["version"], "docs"] += r["n_docs"]
            got[r["source"], r["lang"], r["version"], "tokens"] += r["n_tokens"]
        assert +got == +want
        assert store.ledger().count() == len(held)
    assert len(store._bases()) == 2


def test_attach_salts_beyond_its_bound(spark, docs):
    small = common.cut(docs.groupBy("source").agg(F.count("*").alias("n")))
    for limit in (1000, 0):
        got = common.attach(docs.select("doc_id", "source"), small, "source", "doc_id", most_bytes=limit)
        assert Counter(r["n"] for r in got.collect()) == Counter(n for n in Counter(r[3] for r in corpus()).values() for _ in range(n))


def test_ascii_lower(spark):
    texts = ["ABC", "ÀB", "ΣΑΣ", "İI", "K", "ǅ", "ⅠA", "", "ß😀Z"]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(common.ascii_lower(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in got] == [t.translate(LOWER) for t in texts]


CLASH = ["n", "m", "sig", "region", "digest", "d1", "recipe_", "key", "keep", "hash", "drop", "label", "component", "host", "failed", "size_", "h", "w", "place", "ids_", "block", "t", "x", "i", "rn", "queue"]


def edge_rows():
    """(doc_id, text, source): null ids, texts and sources, repeated rows, ties, a very long text; with columns of every name."""
    long, line = "long words " * 60_000, "a line that many documents share with others"
    return [
        (None, "Some text of ten words or more, to be kept as it is now", "a"), (None, None, None), (1, line, "a"), (1, line, "a"), (2, line.upper() + "\nother", "b"),
        (3, line + "\n" + line, None), (4, long, "b"), (5, "", "a"), (5, "", "a"), (6, "tie one", "a"), (6, "tie two", "a"), (None, line, "a"),
    ]


@pytest.fixture(scope="module")
def edges(spark):
    wide = [(*r, *[f"{k}-{j}" for j in range(len(CLASH))]) for k, r in enumerate(edge_rows())]
    return spark.createDataFrame(wide, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)).persist()


def test_edges_of_exact_dedup(edges):
    got = sorted((r.asDict() for r in exact_dedup.dedup(edges).collect()), key=lambda r: int(r["n"].split("-")[0]))
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in got] == [
        (None, 1, True), (5, 3, False), (1, 3, True), (1, 3, True), (2, 1, True), (3, 1, True), (4, 1, True), (5, 3, True), (5, 3, True), (6, 1, True), (6, 1, True), (1, 3, False)
    ]
    assert all(r[c] == f"{k}-{j}" for k, r in enumerate(got) for j, c in enumerate(CLASH))


def test_edges_of_line_dedup(edges):
    got = sorted((r.asDict() for r in line_dedup.dedup_lines(edges).collect()), key=lambda r: int(r["n"].split("-")[0]))
    texts = [r[1] or "" for r in edge_rows()]
    texts[2] = texts[3] = texts[11] = ""
    texts[4] = "other"
    assert [r["text"] for r in got] == texts
    assert [r["n_dropped"] for r in got] == [0, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1]
    assert all(r[c] == f"{k}-{j}" for k, r in enumerate(got) for j, c in enumerate(CLASH))


def test_edges_of_ngram_jaccard(edges):
    got = sorted((r.asDict() for r in ngram_jaccard.join(edges.drop("component")).collect()), key=lambda r: int(r["n"].split("-")[0]))
    assert [r["component_id"] for r in got] == [None, None, 1, 1, 1, 3, 4, 5, 5, 6, 6, 1]
    assert [r["n_shingles"] for r in got] == [brute_components([(0, t)])[0][0][0] for _, t, _ in edge_rows()]


def test_edges_of_classifiers(edges, spark):
    model = toxicity.fit(["bad vile words", "good kind words"] * 20, np.array([1, 0] * 20))
    crf = line_crf.fit(["BAD!! ##\nVILE!!", "a good line of words.\nand one more."] * 20, np.array([0, 1] * 20))
    for got in (toxicity.classify(edges, model, {None: 0.5}), line_crf.classify(edges, crf)):
        rows = sorted((r.asDict() for r in got.collect()), key=lambda r: int(r["n"].split("-")[0]))
        assert len(rows) == len(edge_rows())
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert rows[2]["score"] == rows[3]["score"] == rows[11]["score"] and rows[1]["score"] == rows[7]["score"]
        assert all(r[c] == f"{k}-{j}" for k, r in enumerate(rows) for j, c in enumerate(CLASH))
    none = edges.where("false")
    assert toxicity.classify(none, model, {None: 0.5}).count() == line_crf.classify(none, crf).count() == 0


def test_edges_of_bpe(edges):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(edges.withColumn("ids", F.lit("clash")), path).withColumn("decoded", F.lit("clash"))
    rows = sorted((r.asDict() for r in byte_bpe.decode(encoded, path).collect()), key=lambda r: int(r["n"].split("-")[0]))
    assert [bytes(r["decoded"]).decode() for r in rows] == [r[1] or "" for r in edge_rows()]
    assert all(r["offsets"][:1] in ([], [0]) and len(r["offsets"]) == len(r["ids"]) for r in rows)
    bare = byte_bpe.decode(encoded.drop("offsets"), path).select("decoded", "n").collect()
    assert {r["n"]: bytes(r["decoded"]) for r in bare} == {r["n"]: bytes(r["decoded"]) for r in rows}
    with pytest.raises(Exception, match="offsets don't fit"):
        byte_bpe.decode(encoded.withColumn("offsets", F.transform("offsets", lambda x: x + 1)), path).collect()


def test_edges_of_host_rules_and_mixing(edges):
    rows = sorted((r.asDict() for r in host_rules.judge(edges).collect()), key=lambda r: int(r["n"].split("-")[0]))
    assert [r["n_words"] for r in rows] == [len(WORD.findall(t or "")) for _, t, _ in edge_rows()]
    assert rows[2]["kept"] == rows[3]["kept"]
    assert all(r[c] == f"{k}-{j}" for k, r in enumerate(rows) for j, c in enumerate(CLASH))
    got = mixing.mix(edges).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, len(WORD.findall(t or ""))) for i, t, _ in edge_rows())
    assert mixing.mixture(edges).columns == edges.columns


def test_convolution_and_pooling_match_plain_loops():
    """Scores of the tables against filters slid over each text, word by word."""
    model = toxicity.fit(["bad vile words here", "good kind words there", "vile", "kind"] * 10, np.array([1, 0, 1, 0] * 10), epochs=2)
    texts = ["", "one", "bad vile words", "kind words there and then vile", "x y z bad"]
    for text, ids in zip(texts, toxicity._encoded(texts), strict=True):
        vectors = model.embed[ids].sum(axis=1)
        pooled = []
        for w, filters in model.filters.items():
            for f in range(filters.shape[2]):
                best = 0.0
                for p in range(len(ids) - toxicity.PAD):
                    best = max(best, sum(float(vectors[p + k] @ filters[k, :, f]) for k in range(w) if p + k < len(ids)))
                pooled.append(best)
        want = 1 / (1 + np.exp(-(np.array(pooled) @ model.weights.astype(np.float64) + float(model.bias))))
        assert np.isclose(model.score(ids, np.array([0, len(ids)]))[0], want, atol=1e-4)
        assert len(ids) == toxicity.PAD + len(text.split())


def test_thresholds_come_from_rows_that_the_fit_never_saw(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["vile", "bad"] if k % 3 == 0 else ["kind", "good"]) for _ in range(9)), "en" if k % 2 else "de", int(k % 3 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    fitted, real = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: fitted.append(len(texts)) or real(texts, y))
    model, limits = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic").union(docs.select("doc_id", F.lit(0))), F.lit(True))
    assert fitted == [320] and {None, "en", "de"} >= set(limits)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.classify(docs.drop("toxic"), model, limits).collect()}
    assert np.mean([got[i] == bool(y) for i, _, _, y in rows]) > 0.98
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)
    small = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), F.lit(True), max_bytes=2000)
    assert fitted[1] < 60 and small[1]


def test_line_scores_are_weighted_by_length_and_read_both_neighbours():
    """Features and document scores of a fitted model against plain loops over lines."""
    rng = random.Random(2)
    texts = ["\n".join("".join(rng.choice("aB 1#!.é ") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))) for _ in range(40)] + ["", "\n\n", "x x y"]
    model = line_crf.fit(texts, np.array([k % 2 for k in range(len(texts))]), steps=8)
    for _, _, data, offsets in blocks(pa.array(texts, pa.large_string())):
        features, size, first = line_crf.line_features(data, offsets)
        scores, good, _ = model.score(data, offsets)
    for k, text in enumerate(texts):
        lines = text.split("\n")
        own = features[first[k] : first[k + 1]]
        assert len(own) == len(lines)
        emits = []
        for line, f in zip(lines, own, strict=True):
            raw, words = line.encode(), re.findall(rb"[^\x20\x09-\x0D]+", line.encode())
            letters = sum(b >= 128 or chr(b).isalpha() for b in raw)
            per_word, per_byte = max(len(words), 1), max(len(raw), 1)
            low = [w.lower() for w in words]
            want = [
                np.log2(1 + len(raw)), np.log2(1 + len(words)), sum(map(len, words)) / per_word, sum(65 <= b <= 90 for b in raw) / max(letters, 1), sum(48 <= b <= 57 for b in raw) / per_byte,
                raw.count(b"#") / per_word, raw.count(b"!") / per_word, raw.count(b".") / per_word, sum(a == b for a, b in zip(low, low[1:], strict=False)) / per_word,
                len(set(low)) / per_word, max(letters, 1) / per_byte, sum(len(w) == 1 for w in words) / per_word, float(raw[-1:] == b"."),
            ]
            assert np.allclose(f, want)
        bins = [[int(np.searchsorted(e, f[j], "right")) for j, e in enumerate(model.edges)] for f in own]
        for i in range(len(lines)):
            total = model.bias
            for place, at in ((0, i), (1, i - 1), (2, i + 1)):
                total += sum(model.weights[place, j][bins[at][j] if 0 <= at < len(lines) else line_crf.BINS + 1] for j in range(len(model.edges)))
            emits.append(total)
        marginal = line_crf.marginals(np.array(emits), np.array([0, len(lines)]), model.pair, model.begin)
        assert np.allclose(marginal, good[first[k] : first[k + 1]])
        weights = [len(x.encode()) for x in lines] if text.strip("\n") else [1] * len(lines)
        assert np.isclose(scores[k], np.average(marginal, weights=weights))
