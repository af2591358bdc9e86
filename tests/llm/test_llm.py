"""Each training-data operator against a brute-force version, with nulls, empty and long texts, repeated rows and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vestige.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def documents(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "src0", None if t is None else len(t), "x", 1) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    """The small table and awkward rows: null, empty, blank, repeated, long."""
    own = [r.text for r in table(spark, "documents").orderBy("doc_id").collect()]
    return own[:120] + [None, "", "  \n\t ", own[3], own[3], "a b c", "lone", " ".join(own[:60]), "x " * 200, "é" * 5000]


def test_empty_tables(spark):
    none = documents(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    from vestige.llm import covertree, decontaminate, language, linededup, lm, packing, simhash, substrings, tokencount, toxicity

    for df in (
        decontaminate.contamination(none, bench), lm.scores(none), linededup.line_classes(none), linededup.without_repeated_lines(none), substrings.digest(none), simhash.op6(none), simhash.keep_one(none), tokencount.token_counts(none, Q.vocabulary_path()), packing.pack(none, Q.vocabulary_path()),
        language.accepted_documents(none), covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")), toxicity.toxicity(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")),
    ):
        assert df.count() == 0


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_contamination(spark, texts):
    from vestige.llm.decontaminate import contamination, without_contaminated

    items = [(1, " ".join(texts[3].split()[:30])), (2, "lone"), (3, None), (None, "a b c"), (10, texts[5]), (10, ",,,"), (7, "zzz qqq not there")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, text in items:
        w = word_list(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add("null" if item is None else str(item))
    got = {r.doc_id: r for r in contamination(documents(spark, texts), bench).collect()}
    clean = set()
    for k, text in enumerate(texts):
        w = word_list(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        bad = bool(hit) and 20 * len(hit) >= len(w)
        if not bad:
            clean.add(k)
        assert (got[k].n_words, got[k].n_hit, got[k].n_items, got[k].items_sha256, got[k].contaminated) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bad)
    assert {r.doc_id for r in without_contaminated(documents(spark, texts), bench).collect()} == clean


def test_lm_scores(spark, texts):
    from vestige.llm.lm import SIZE, scores, tokens

    rows = {r.doc_id: r for r in scores(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert rows[k].n_tokens == len(tokens(t)) and rows[k].log_likelihood <= 0
        assert (rows[k].mean is None) == (rows[k].n_tokens == 0)
    assert rows[3].log_likelihood == pytest.approx(rows[123].log_likelihood, rel=1e-5)  # repeated rows
    ordinary = np.mean([rows[k].mean for k in range(100) if rows[k].n_tokens > 20])
    assert ordinary > -np.log(SIZE)  # better than all words alike


@pytest.mark.parametrize("shared", [1 << 17, 20, 0])
def test_lm_scores_by_plain_loops(spark, texts, shared, monkeypatch):
    """Each document's sum from the fitted network, token by token, with counts of all tokens; shares by broadcast, by both ways and by join."""
    from collections import Counter

    from vestige.llm import lm

    monkeypatch.setattr(lm, "SHARED", shared)
    kept = {}
    monkeypatch.setattr(lm, "fit", lambda *of, fit=lm.fit: kept.setdefault("model", fit(*of)))
    rows = texts[:40] + texts[-6:] + ["Ünïcode ΣΑΣ don't 3.5", "w " * 30_000]
    got = {r.doc_id: r for r in lm.scores(documents(spark, rows).coalesce(2)).collect()}
    lists = [re.findall(r"\w+|[^\w\s]", (t or "").lower()) for t in rows]
    counts = Counter(w for x in lists for w in x)
    hashed = dict(zip(counts, lm.token_hashes(list(counts)).tolist()))
    named = sorted(counts, key=lambda w: (-counts[w], hashed[w]))[: lm.NAMED]
    number = {w: k for k, w in enumerate(named)}
    bucket = {w: hashed[w] % lm.BUCKETS for w in counts}
    totals = Counter()
    for w, n in counts.items():
        if w not in number:
            totals[bucket[w]] += n
    m = {k: v.astype(float) for k, v in kept["model"].items()}
    for k, own in enumerate(lists):
        total, ids = 0.0, [lm.SIZE] * 2 + [number.get(w, lm.NAMED + bucket[w]) for w in own] + [lm.SIZE] * 2
        for i, w in enumerate(own[:3000]):
            x = np.concatenate([m["embed"][ids[j]] for j in (i, i + 1, i + 3, i + 4)])
            h = np.tanh(x @ m["w1"] + m["b1"])
            c, member = ids[i + 2] % lm.CLASSES, ids[i + 2] // lm.CLASSES
            for y, at in ((h @ m["wc"] + m["bc"], c), (h @ m["wi"][c] + m["bi"][c], member)):
                total += y[at] - np.log(np.exp(y).sum())
            if w not in number:
                total += np.log(counts[w] / (totals[bucket[w]] + 1))
        if len(own) <= 3000:
            assert got[k].n_tokens == len(own) and got[k].log_likelihood == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_lm_probabilities_sum_to_one():
    from vestige.llm.lm import SIZE, log_probabilities, start

    context = np.tile(np.array([[5, 9, 11, 2]], np.int32), (SIZE, 1))
    assert np.exp(log_probabilities(start(), context, np.arange(SIZE))).sum() == pytest.approx(1, abs=1e-4)


def test_lm_gradient():
    """A step moves every weight against the difference quotient of the loss."""
    from vestige.llm import lm

    rng = np.random.default_rng(0)
    context, target = rng.integers(0, lm.SIZE + 1, (300, 4)).astype(np.int32), rng.integers(0, lm.SIZE, 300).astype(np.int32)
    model, state = {k: v.astype(np.float64) for k, v in lm.start().items()}, {}
    moved = {k: v.copy() for k, v in model.items()}
    lm.train(moved, context, target, state)
    for k in model:
        flat = np.argsort(np.abs(moved[k] - model[k]).ravel())[-3:]
        for i in flat:
            at = np.unravel_index(i, model[k].shape)
            loss = []
            for d in (1e-5, -1e-5):
                other = {n: v.copy() for n, v in model.items()}
                other[k][at] += d
                loss.append(-lm.log_probabilities(other, context, target).sum())
            slope = (loss[0] - loss[1]) / 2e-5
            assert np.sqrt(state[k][at] - 1e-6) * np.sqrt(300) == pytest.approx(abs(slope), rel=1e-3) and np.sign(model[k][at] - moved[k][at]) == np.sign(slope)


def test_lm_scores_of_unnamed_tokens(spark):
    """Of two unnamed tokens of one bucket in the same places, one that occurs 3 times is 3 times as likely as one that occurs once."""
    from vestige.llm.lm import BUCKETS, NAMED, scores, token_hashes

    def token_hash(word):
        return int(token_hashes([word])[0])

    named = [f"w{i:05d}" for i in range(NAMED)]
    bucket = token_hash("x0") % BUCKETS
    often, once = "x0", next(w for w in (f"x{i}" for i in range(1, 100_000)) if token_hash(w) % BUCKETS == bucket)
    texts = [" ".join(named[i : i + 40]) for i in range(0, NAMED, 40)] * 4
    texts += [f"w00001 w00002 {x} w00003 w00004" for x in (often, once, often, often)]
    rows = {r.doc_id: r for r in scores(documents(spark, texts).coalesce(2)).collect()}
    a, b = rows[len(texts) - 4], rows[len(texts) - 3]
    assert a.log_likelihood - b.log_likelihood == pytest.approx(np.log(3), abs=1e-4)
    assert b.mean == pytest.approx(b.log_likelihood / 5)


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        p, d[0] = d[:], i + 1
        for j, y in enumerate(b):
            d[j + 1] = min(p[j] + (x != y), p[j + 1] + 1, d[j] + 1)
    return d[-1]


def brute_lines(texts, k):
    from vestige.llm.linededup import LEAST, normalise

    places = {}
    for d, t in enumerate(texts):
        for j, line in enumerate(normalise(t)):
            if line:
                places.setdefault(line, []).append((d, j))
    lines = sorted(places)
    root, n = {x: x for x in lines}, dict.fromkeys(lines, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_length = {}
    for x in lines:
        by_length.setdefault(len(x), []).append(x)
    for x in lines:
        for length in range(len(x), len(x) + k + 1):
            for y in by_length.get(length, ()):
                if (length > len(x) or x < y) and len(x) >= LEAST and (x[: len(x) // 2 - k] == y[: len(x) // 2 - k] or x[-(len(x) // 2) + k :] == y[-(len(x) // 2) + k :] or len(x) < 40) and distance(x, y) <= k:
                    n[x] += 1
                    n[y] += 1
                    root[find(x)] = find(y)
    best = {}
    for x in lines:
        best[find(x)] = min([best.get(find(x), (1 << 60, 0)), *places[x]])
    return {(d, j, *best[find(x)], n[x], (d, j) == best[find(x)]) for x in lines for d, j in places[x]}


@pytest.mark.parametrize("crowd", [40, 2])
def test_line_classes(spark, texts, crowd, monkeypatch):
    from vestige.llm import linededup

    monkeypatch.setattr(linededup, "CROWD", crowd)
    base = "The quick brown fox jumps over the lazy dog"
    near = [base, base + "s", base.replace("fox", "fax"), base.replace("quick", "quirk"), base.replace("lazy", "hazy"), base[1:], "Page 12 of 99\nPage 13 of 98", "short\nshorx", base.replace("fox", "fix")] + [base.replace("dog", "d%sg" % c) for c in "abcdefgh"]
    rows = texts[:60] + near + [None, "", " \n"] + texts[:3]
    got = {tuple(r) for r in linededup.line_classes(documents(spark, rows)).select("doc_id", "line_no", "class_doc", "class_line", "n_links", "kept").collect()}
    assert got == brute_lines(rows, 1)
    if crowd == 40:
        kept = {(d, j) for d, j, *_, k in got if k}
        out = linededup.without_repeated_lines(documents(spark, rows))
        assert out.columns == documents(spark, []).columns
        for r in out.collect():
            want = rows[r.doc_id] and "\n".join(x for j, x in enumerate(rows[r.doc_id].split("\n")) if not x.strip() or (r.doc_id, j) in kept)
            assert r.text == want


def test_line_classes_of_two_edits(spark):
    from vestige.llm.linededup import line_classes

    rows = ["abcdefghij", "abcdefghijkl", "abXdefgYij", "abXdefgYZZ", "bcdefghi", "something else"]
    got = {tuple(r) for r in line_classes(documents(spark, rows), 2).select("doc_id", "line_no", "class_doc", "class_line", "n_links", "kept").collect()}
    assert got == brute_lines(rows, 2)


def brute_repeats(texts, window):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for d, w in enumerate(lists):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in texts]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + window))
    return {d: (len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for d, (w, g) in enumerate(zip(lists, gone))}


@pytest.mark.parametrize("most", [400_000, 200, 1])
def test_substrings(spark, texts, most, monkeypatch):
    """The same result with one tree, with groups split by longer prefixes, and with every group split down to whole windows."""
    from vestige.llm import substrings

    monkeypatch.setattr(substrings, "GROUP_WORDS", most)
    long = texts[7].split()
    rows = texts + [" ".join(long[:36]) + " end", "head " + " ".join(long[:35]), " ".join(long[1:36]), "  b " * 40, " ".join("ab"[i % 2] for i in range(80)), " ".join(f"w{i % 37}" for i in range(150))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(documents(spark, rows)).collect()}
    assert got == brute_repeats(rows, 35)


def thue_morse(n):
    x = "0"
    while len(x) < n:
        x += x.translate({48: 49, 49: 48})
    return x


def test_substrings_tell_colliding_words_apart(spark):
    """Two words whose polynomial hashes modulo 2^64 are equal for every odd base: windows that differ in them alone are no repeats."""
    from vestige.llm import substrings

    one = thue_morse(2048)
    other = one.translate({48: 49, 49: 48})
    a, b = substrings.Words([one.encode()]), substrings.Words([other.encode()])
    assert a.hash[0] == b.hash[0]
    common = " ".join(f"c{i}" for i in range(34))
    rows = [f"{common} {one}", f"{common} {other}", f"{one} {common}", f"{other} {common}"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(documents(spark, rows)).collect()}
    assert got == brute_repeats(rows, 35) and all(r[1] == 0 for r in got.values())


def test_suffix_tree_nodes():
    """Topmost nodes of each depth, and the depths at which neighbours part, against comparing all pairs of suffixes."""
    from vestige.llm.substrings import SuffixTree

    rng = np.random.default_rng(8)
    rows = [" ".join(map(str, rng.integers(0, 3, n))).encode() for n in (1, 5, 30, 60)]
    tree = SuffixTree(rows, 4)
    suffixes = {int(f) + i: x.split()[i:] for f, x in zip(tree.first, rows) for i in range(len(x.split()))}
    for depth in (2, 3, 4):
        prefixes = {}
        for at, s in suffixes.items():
            if len(s) >= depth:
                prefixes.setdefault(tuple(s[:depth]), set()).add(at)
        first, last = tree.deep_nodes(depth)
        assert sorted(map(sorted, (tree.leaves[a : b + 1].tolist() for a, b in zip(first, last)))) == sorted(sorted(x) for x in prefixes.values() if len(x) > 1)


def test_substrings_at_every_distance(spark):
    """Passages of exactly a window, one word less and one more, between words that differ, at many places."""
    from vestige.llm import substrings

    rng = np.random.default_rng(3)
    word = lambda n: [f"q{x}" for x in rng.integers(0, 1 << 40, n)]
    rows = []
    for size in (34, 35, 36, 60):
        for _ in range(25):
            passage = word(size)
            rows += [" ".join(word(int(rng.integers(0, 50))) + passage + word(int(rng.integers(0, 50)))) for _ in range(2)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(documents(spark, rows)).collect()}
    assert got == brute_repeats(rows, 35)


def test_toxicity(spark):
    from vestige.llm.toxicity import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) >= 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.85


def test_toxicity_marginals_and_spans_by_enumeration():
    """Marginals against summing all tag sequences, and the places of tokens that are likelier toxic than not."""
    from itertools import product

    from vestige.llm.toxicity import Crf

    crf = Crf({"bad$": 3.0, "mild$": 0.7, "nice$": -1.0}, -1.5, np.array([[0.4, -0.6], [-0.3, 0.8]]), np.array([-1.0, 0.5, 0.5, 0.5, 0.0]))
    text = "İx Bad one mild BAD two nice bad three four mild İ bad"
    words = ["İx", "bad", "one", "mild", "bad", "two", "nice", "bad", "three", "four", "mild", "İ", "bad"]
    weight = [crf.weights.get(w + "$", 0.0) + crf.bias for w in words]
    mass = np.zeros((len(words), 2))
    for tags in product((0, 1), repeat=len(words)):
        p = np.exp(sum(t * w for t, w in zip(tags, weight)) + sum(crf.transitions[a, b] for a, b in zip(tags, tags[1:])))
        mass[np.arange(len(words)), tags] += p
    want = mass[:, 1] / mass.sum(axis=1)
    at, p = crf.marginals(crf.evidence(words))
    assert [words[k] in ("bad", "mild", "nice") for k in at] == [True] * len(at) and p == pytest.approx(want[at])
    _, spans = crf.tag(text)
    likely = [k for k in at.tolist() if want[k] >= 0.5]
    assert likely and [text[s["start"] : s["stop"]].lower() for s in spans] == [words[k] for k in likely]
    assert [s["probability"] for s in spans] == pytest.approx([want[k] for k in likely])
    assert crf.tag(None) == crf.tag("") and crf.tag("")[1] == []


def test_toxicity_of_odd_rows(spark):
    from vestige.llm.toxicity import toxicity

    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark, [f"word{'xyz'[i % 3]} plain text {'vile ' * (i % 2)} number {'abcdefgh'[i % 8]}" for i in range(40)] + [None, "", "vile " * 50_000, "word", "word"]).withColumn("score", F.lit("mine"))
    docs = docs.unionByName(docs.where("doc_id = 43").withColumn("doc_id", F.lit(None).cast("long")))
    got = toxicity(docs, labels).collect()
    assert len(got) == 46 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[40].score == by[41].score and by[43].score == by[44].score == by[None].score and not by[None].held_out


def test_toxicity_of_a_capped_sample(spark, monkeypatch):
    """5 % of documents are toxic, the capped sample is half toxic: a word in 9 of 10 toxic and 1 of 10 clean documents is no proof."""
    from vestige.llm import toxicity as X

    monkeypatch.setattr(X, "SAMPLE_DOCS", 120)
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(4000):
        toxic = int(i % 20 == 0)
        words = [f"{'bcdfghjklmnp'[a]}o{'bcdfghjklmnp'[b]}a" for a, b in rng.integers(0, 12, (30, 2))]
        words += ["qwerty"] * int(rng.random() < (0.9 if toxic else 0.1)) + ["zuxxing"] * int(rng.random() < (0.6 if toxic else 0.005))
        docs.append((i, " ".join(rng.permutation(words))))
        labels.append((i, 0, toxic))
    found = X.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("held_out").collect()
    hit = sum(r.predicted and r.doc_id % 20 == 0 for r in found)
    assert hit / sum(r.predicted for r in found) > 0.6 and hit / sum(r.doc_id % 20 == 0 for r in found) > 0.45


def test_simhash(spark, texts):
    from xxhash import xxh64_intdigest

    from vestige.llm.simhash import keep_one, op6

    rows = texts + [texts[9] + " more", texts[9] + " words", texts[20][:-1]]
    prints = []
    for t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2) if w else 0)]
        h = [xxh64_intdigest(g.encode(), seed=42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))
    for _ in rows:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if root[j] < root[i] and bin(prints[i] ^ prints[j]).count("1") <= 2:
                    root[i], changed = root[j], True
        if not changed:
            break
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op6(documents(spark, rows)).collect()}
    assert got == {i: (f"{p:016x}", r) for i, (p, r) in enumerate(zip(prints, root))}
    assert {r.doc_id for r in keep_one(documents(spark, rows), shingle=3).collect()} == set(root)


def test_rows_keep_their_numbers_behind_a_shuffle(spark):
    """Row numbers behind a shuffle whose partitions are joined at run time, with one wide column: the same rows stay and the same lines go."""
    from vestige.llm import language, linededup, simhash, substrings

    plain = table(spark, "documents")
    wide = plain.dropDuplicates(["doc_id"]).withColumn("wide", F.repeat(F.md5(F.col("doc_id").cast("string")), 200)).withColumn("place", F.lit("mine")).withColumn("lines_out", F.lit(1))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("64k", "false", "64")):
        spark.conf.set(k, v)
    try:
        for f in (simhash.keep_one, language.accepted_documents, linededup.without_repeated_lines):
            want = {(r.doc_id, r.text) for r in f(plain).select("doc_id", "text").collect()}
            out = f(wide)
            assert out.columns == wide.columns and {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()} == want, f.__name__
            assert out.where("place <> 'mine' or lines_out <> 1").count() == 0
        for f in (substrings.digest, linededup.line_classes):
            assert set(map(tuple, f(wide).collect())) == set(map(tuple, f(plain).collect()))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_simhash_crowds(spark):
    """Random walks of bit flips around one fingerprint, in cells far above the crowd's size."""
    from vestige.llm.simhash import classes

    rng = np.random.default_rng(1)
    prints = {0x0123456789ABCDEF}
    while len(prints) < 500:
        x = rng.choice(np.array(sorted(prints), np.uint64))
        prints.add(int(x) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5))))
    own = sorted(np.array(sorted(prints), np.uint64).view(np.int64).tolist())
    got = {r.node: r.root for r in classes(spark.createDataFrame([(x,) for x in own], "fp long")).collect()}
    root = {x: x for x in own}
    changed = True
    while changed:
        changed = False
        for x in own:
            for y in own:
                if root[y] < root[x] and bin((x ^ y) & (1 << 64) - 1).count("1") <= 2:
                    root[x], changed = root[y], True
    assert {x: got.get(x, x) for x in own} == root


def test_embeddings(spark):
    from vestige.llm.covertree import near_duplicates

    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 16))
    vecs = np.concatenate([base, base + rng.normal(scale=0.03, size=base.shape), base[:5] * 2]).tolist()
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    rows = [(i, v, None if i % 11 == 0 else i % 30 % 3, "x") for i, v in enumerate(vecs + odd)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, root string")).collect()}
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v, label, _ in rows if i < len(vecs) and label is not None}
    link = {i: {j for j in unit if i != j and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98} for i in unit}
    root = {r[0]: r[0] for r in rows}
    for _ in rows:
        for i, near in link.items():
            root[i] = min([root[i], *(root[j] for j in near)])
    assert got == {i: (len(link.get(i, ())), root[i], root[i] == i) for i in root}


def test_language(spark):
    from vestige.llm.language import accepted_documents, identify_all

    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "pages"))
    rows = identify_all(docs, pages).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id", "left").collect()
    assert len(rows) == docs.count() + pages.count()
    known = [r for r in rows if r.doc_id is not None and r.accepted and r.lang is not None]
    assert np.mean([r.language == r.lang for r in known]) > 0.95
    odd = documents(spark, [None, "", "  "]).withColumn("extra", F.lit(1))
    kept = accepted_documents(docs.withColumn("extra", F.lit(1)).unionByName(odd.select(*docs.columns, "extra")))
    assert kept.columns == [*docs.columns, "extra"] and kept.where("text is null or trim(text) = ''").count() == 0


def test_token_counts_and_packing(spark, texts):
    from tokenizers import Tokenizer

    from vestige.llm.packing import pack
    from vestige.llm.tokencount import token_counts

    t = Tokenizer.from_file(Q.vocabulary_path())
    rows = texts + ["İΣσς ﬁ ½ ²", "<|startoftext|>abc <|endoftext|>", "don't I'LL 've", " 　a\u0085b", "日本語のテキスト 123 ١٢٣", "a" * 3000, "é ퟿ \U0001f600\U0001f600"]
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in rows]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(documents(spark, rows), Q.vocabulary_path()).collect()}
    assert got == {i: (len((x or "").encode()), len(own), len(own) > 2048) for i, (x, own) in enumerate(zip(rows, ids))}
    pieces = pack(documents(spark, rows), Q.vocabulary_path()).collect()
    for i, own in enumerate(ids):
        own, at = [*own, 2], 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(np.array(own[at : at + p.length], np.uint32).tobytes())
            at += p.length
        assert at == len(own)
    used = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == used.get(p.sequence_id, 0) and p.length > 0
        used[p.sequence_id] = p.offset + p.length
    assert max(used.values()) <= 4096


def test_differencing_is_near_equal():
    from vestige.llm.packing import windows

    sizes = np.random.default_rng(2).integers(1, 513, 3000)
    part, k = windows(sizes, 4096)
    sums = np.bincount(part, sizes, k)
    assert sums.max() <= 4096 and sums.max() - sums.min() < 64 and k - sizes.sum() / 4096 < 3


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = table(spark, "documents").withColumn("extra", F.lit(1))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert P.run(spark, SF).count() > 0
