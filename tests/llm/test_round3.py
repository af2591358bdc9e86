"""Personal data, whitening, alignment and row numbers against brute force, with nulls, odd texts, repeated rows, extra columns and empty tables."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from vestige.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, found string, row string, base string, pair long"


def table(spark, rows, start=0):
    return spark.createDataFrame([(start + i, t, "x", "y", "z", 1) for i, t in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    own = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    return own[:100] + [None, "", " ", "  \n\t ", own[3], own[3], "é" * 3000, " ".join(own[:40])]


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    n = lambda h: re.sub("[^0-9]", "", h)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: max(map(int, h.split("."))) <= 255),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 12 <= len(n(h)) <= 19 and luhn(n(h))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 9 <= len(n(h)) <= 15),
    ]
    return sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m.group()))


ODD = [
    None, "", " ", "a@b.c@d.e", "a@b.c.@d.e", "..a@b.c..d@e.f@g.h", "1.2.3.4.5.6.7.8.9", "001.0255.3.4 256.1.1.1", "1.2.3.4é🤦‍♂️ x@y.z", "4111 1111 1111 1111-4111", "4111-1111-1111-1111 ", "0" * 12, "0" * 20, "1 2 3 4 5 6 7 8 9 1 2 3 4",
    "a@b." + "c." * 20000 + "d", "+1 (" + ")" * 1000 + "2345678 9", " +12", "x+49 30 1234567-", "mail a@b.cc " * 3000, "card 123456789012 3456 7890 and 4539578763621486 4539578763621486", "4539578763621486-12", "12 453957876362148612",
]


def test_personal_base(spark, texts):
    from vestige.llm.personal import digest

    every = [*texts, *ODD]
    rows = {r.doc_id: r for r in digest(table(spark, every)).collect()}
    assert len(rows) == len(every)
    for i, t in enumerate(every):
        base = base_spans(t)
        said = ",".join(f"{n}:{a}:{b}" for a, _, b, n in base)
        assert rows[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), i
        assert [rows[i][f"n_{n}"] for n in ("email", "ip", "card", "phone")] == [sum(x[3] == n for x in base) for n in ("email", "ip", "card", "phone")]
        assert set(filter(None, said.split(","))) <= set(rows[i].spans.split(","))


def test_personal_added_spans(spark):
    from vestige.llm.personal import personal_data

    said = ["GB82 WEST 1234 5698 7654 32 bank", "GB83 WEST 1234 5698 7654 32 bank", "ssn 123-45-6789", "123-45-6789", "tax 900-12-3456", "7536784127813050 4845168114407329", "a4845168114407329b", "4845168114407329", "visa 4845168114407329"]
    rows = {r.doc_id: [(s.kind, s.start, s.stop, s.score) for s in r.found] for r in personal_data(table(spark, said)).collect()}
    assert rows == {0: [("iban", 0, 27, 100)], 1: [], 2: [("social", 4, 15, 55)], 3: [], 4: [], 5: [("card", 0, 16, 50), ("card", 17, 33, 50)], 6: [("card", 1, 17, 70)], 7: [("card", 0, 16, 70)], 8: [("card", 5, 21, 90)]}


def test_personal_very_long_texts(spark):
    from vestige.llm.personal import digest

    long = ["9" * 2_000_000, "a" * 2_000_000, "a@" * 300_000, "1-" * 300_000, "+1 " * 300_000, "AB12" * 300_000]
    assert [r.n_email + r.n_ip + r.n_card + r.n_phone for r in digest(table(spark, long)).orderBy("doc_id").collect()] == [0, 0, 0, 0, 0, 0]


def test_personal_agrees_with_sql_on_random_texts(spark, tmp_path):
    draw = random.Random(3)
    parts = ["0", "4539578763621486", "000000000000", "1", "5", " ", "-", " ", "a", "+1", "é", ".", "@", "x", "12", "\n", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789", "2", "3", "card "]
    rows = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 30))) for _ in range(2000)] + ODD[:14]
    table(spark, rows).unionByName(table(spark, rows[:3]).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(Q.OP11_SQL).fetchall(), key=str) == sorted(map(tuple, Q.op11_personal_data(spark, str(tmp_path)).collect()), key=str)


def test_running_sums(spark):
    from vestige.llm.personal import running

    rows = [[], [5], list(range(1, 1000)), [0] * 10]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<long>").select("i", running(F.col("a")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [np.cumsum(r).tolist() for r in rows]


VECTORS = "vec_id long, embedding array<float>, label int, n long, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VECTORS)


def exact(rows):
    """n, the sums and the covariance of x by fractions."""
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for v in rows], object)
    n, s = len(x), x.sum(axis=0)
    cov = [[Fraction(int(n * (x[:, i] * x[:, j]).sum() - s[i] * s[j]), n * n) for j in range(x.shape[1])] for i in range(x.shape[1])]
    return x, n, s, np.array([[float(c) for c in r] for r in cov])


@pytest.mark.parametrize("scale", [1.0, 3e3, 1e9])
def test_whitening(spark, scale):
    from vestige.llm.whitening import whitened

    draw = np.random.default_rng(5)
    good = (draw.normal(size=(300, 40)) @ np.diag(np.linspace(3, 1, 40)) * scale).astype(np.float32).tolist()
    odd = [(900, None), (901, []), (902, [None] * 40), (903, [float("nan")] + [0.0] * 39), (904, [float("inf")] * 40), (905, [1.0] * 3), (906, [3e38] * 40)]
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[0]), (7, good[7])]
    got = whitened(vectors(spark, rows + odd)).collect()
    x, n, s, cov = exact([v for _, v in rows])
    assert len(got) == n * 32 and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 33))
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    square = sorted(int(t) if t < 1 << 63 else -1 for t in ((n * x - s) ** 2).sum(axis=1))
    assert sorted(-1 if r.deviation is None else r.deviation for r in got if r.component == 1) == square
    centre = np.array((n * x - s) / n, float)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-6 and r.identity_error < 1e-8
    for c in range(32):
        want = centre @ axes[:, c] / np.sqrt(values[c])
        mine = np.array([by[i][c + 1][0] for i in range(300)])
        assert min(np.abs(mine - want[:300]).max(), np.abs(mine + want[:300]).max()) < 1e-6
    assert len(by[None][1]) == 1 and len(by[7][1]) == 2


def test_whitening_without_variance_and_without_rows(spark):
    from vestige.llm.whitening import whitened

    same = whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    flat = whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in flat] == [False, True, False, True] and flat[0].explained == 1.0 and flat[0].identity_error < 1e-12
    assert whitened(vectors(spark, [])).count() == 0 and whitened(vectors(spark, [(1, None)])).count() == 0


def test_limbs():
    from vestige.llm.whitening import LIMB, limbs

    for x in (0, 1, -1, 10**30, -(10**30), (1 << 90) - 1):
        assert sum(v << (LIMB * k) for k, v in enumerate(limbs(x))) == x


def whole(text, a, b):
    """The alignment of one text from the libraries' ids of all of it."""
    back = {}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for c in plain:
        back[chr(c)] = c
    for k, c in enumerate(x for x in range(256) if x not in plain):
        back[chr(256 + k)] = c
    if not text:
        return None
    ea, eb = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    of_a = [bytes(back[c] for c in t) for t in ea.tokens]
    of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in eb)]
    if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
        return None
    ends_a, ends_b, ids = np.cumsum([*map(len, of_a)]).tolist(), np.cumsum([*map(len, of_b)]).tolist(), ea.ids
    both = sorted(set(ends_a) & set(ends_b))
    # No token of these texts is without bytes, so an end is one token's.
    at_a, at_b = ({e: k + 1 for k, e in enumerate(ends)} for ends in (ends_a, ends_b))
    cuts = [(0, 0), *((at_a[e], at_b[e]) for e in both)]
    assert len(at_a) == len(ends_a) and len(at_b) == len(ends_b)
    groups = [",".join(map(str, ids[i:k])) + "|" + ",".join(map(str, eb[j:m])) for (i, j), (k, m) in zip(cuts, cuts[1:])]
    links = [(ids[k - 1], eb[m - 1]) for k, m in cuts[1:]]
    return len(ids), len(eb), groups, links


def test_alignment(spark, texts, monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    from vestige.llm import alignment as A

    path_a, path_b = P.path(Q.BYTE_LEVEL), P.path(Q.PIECES)
    odd = ["a ", " a", "  a   b ", "a\n b", "a \n  b", "x\n\n y\t z", "▁", "a▁b", "<s> </s> <0x0A> <|endoftext|>", "\x00", "naïve 日本語 🤦‍♂️ x", "don't I'll we've", "1 22 333,4.5", "\r\n \r", " x   y", "w" * 3000, "﷽ ﬁ Å"]
    every = [*texts, *odd]
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    want = [whole(t, a, b) for t in every]
    counts = Counter(x for w in want if w for x in w[3])
    best_a, best_b = Counter(), Counter()
    for (x, y), n in counts.items():
        best_a[x], best_b[y] = max(best_a[x], n), max(best_b[y], n)
    for most in (A.MOST_PAIRS, 0):
        monkeypatch.setattr(A, "MOST_PAIRS", most)
        got = {r.doc_id: r for r in A.alignment(table(spark, every), path_a, path_b).collect()}
        assert len(got) == len(every)
        for i, w in enumerate(want):
            r = got[i]
            if w is None:
                assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", 0), every[i]
            else:
                assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (w[0], w[1], len(w[2]), len(w[3])), every[i][:80]
                assert r.groups_sha256 == hashlib.sha256(";".join(w[2]).encode()).hexdigest()
                assert r.n_best == sum(counts[x] == best_b[x[1]] for x in w[3]) and r.n_best_a == sum(counts[x] == best_a[x[0]] for x in w[3]) and r.count_sum == sum(counts[x] for x in w[3])
    assert A.alignment(table(spark, []), path_a, path_b).count() == 0


def test_alignment_of_whole_texts_where_units_may_not_be_cut(texts, monkeypatch):
    import pyarrow as pa

    from vestige.llm.alignment import Aligner

    cut, uncut = (Aligner(P.path(Q.BYTE_LEVEL), P.path(Q.PIECES)) for _ in range(2))
    uncut.cut = False
    some = pa.array([t or "" for t in texts[:40]])
    (f, d, x), (g, e, y) = cut.align(some), uncut.align(some)
    assert cut.cut and (f == g).all() and d == e and all((p == q).all() for p, q in zip(x, y))


def test_tokens_without_bytes_link_all_that_end_there():
    from vestige.llm.alignment import merged_ends

    assert merged_ends([1, 2, 3], [7, 8], [2, 2, 5], [2, 5]) == (["1,2|7", "3|8"], [(1, 7), (2, 7), (3, 8)], True)
    assert merged_ends([1], [2], [3], [4]) == ([], [], False)


@pytest.fixture(scope="module")
def split_files(spark, tmp_path_factory):
    folder = f"{tmp_path_factory.mktemp('split')}"
    spark.read.parquet(f"{SF}/documents.parquet").repartition(6).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_results_do_not_follow_the_parallelism_of_a_scan(spark, split_files):
    """Each operator at parallelism 4 when it is called and another when its rows are asked for."""
    import corpus_pipeline

    from vestige.llm.language import accepted_documents
    from vestige.llm.linededup import without_repeated_lines
    from vestige.llm.simhash import keep_one
    from vestige.llm.substrings import digest

    said = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for f in (keep_one, accepted_documents, without_repeated_lines, digest):
            found = set()
            for call, action in ((4, 4), (4, 1), (1, 8)):
                spark.conf.set("spark.sql.leafNodeDefaultParallelism", call)
                df = f(spark.read.parquet(f"{split_files}/documents.parquet"))
                spark.conf.set("spark.sql.leafNodeDefaultParallelism", action)
                found.add(said(df))
            assert len(found) == 1, f.__name__
        found = set()
        for call, action in ((4, 4), (4, 1)):  # each stage of the pipeline on its predecessor's rows, without packing, whose sequences follow partitions
            docs, rows = spark.read.parquet(f"{split_files}/documents.parquet"), []
            for _, stage in corpus_pipeline.STAGES[:-1]:
                spark.conf.set("spark.sql.leafNodeDefaultParallelism", call)
                docs = stage(spark, docs, split_files)
                spark.conf.set("spark.sql.leafNodeDefaultParallelism", action)
                rows.append(said(docs))
            found.add(tuple(rows))
        assert len(found) == 1
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_row_numbers_of_a_scan_are_file_and_place(spark, split_files):
    from vestige.llm import common

    docs = spark.read.parquet(f"{split_files}/documents.parquet").withColumn("scan_file", F.lit(1)).where("doc_id is not null")
    rows = common.numbered(docs, "k")
    assert rows.columns == [*docs.columns, "k"] and rows.select("k").distinct().count() == docs.count()
    assert len({r.k >> common._PLACE_BITS for r in rows.select("k").collect()}) == 6
    again = common.numbered(docs.groupBy("doc_id").count(), "k").persist()
    assert again.select("k").distinct().count() == again.count()
