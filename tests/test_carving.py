"""Messages carved from damaged bytes: any cut gives the same, each object once."""

import json
import random

import pytest

from vestige.sources import carving as V


def plain(raw, most):
    """The same by one scan from the start."""
    out, at = [], 0
    for s, e, role, text in V.objects(raw, len(raw), most):
        if s >= at:
            out.append((s, e, role, text))
            at = e
    return out


def damaged(seed):
    draw, out = random.Random(seed), b""
    for i in range(60):
        body = json.dumps({"role": draw.choice(["user", "assistant"]), "content": draw.choice([f"t{i} é {{", 'a "quoted" \\ }', [{"text": f"part {i}"}, {"x": 1}], {"parts": ["p"]}])}, ensure_ascii=draw.random() < 0.5).encode()
        out += draw.choice([body, body[: draw.randrange(len(body))], b'{"wrap": ' + body + b"}", b'{"role": "user", "content": ' + body + b"}", b"\xff\x00" + body, b'"' + body])
        out += draw.choice([b"", b"\n", b"}}]", b'{"', b'{ "a": ', b"\\", b'"'])
    return out


@pytest.mark.parametrize("piece", [7, 64, 1000, 1 << 20])
def test_any_cut_gives_the_same(spark, piece):
    files = [(f"f{k}", damaged(k)) for k in range(4)] + [("empty", b""), ("null", None), ("none", b"{{{{ no message }")]
    got = {}
    for r in V.carve(spark.createDataFrame(files, "path string, content binary"), piece, 4096).collect():
        got.setdefault(r.path, []).append((r.start, r.stop, r.role, r.text))
    want = {name: plain(raw, 4096) for name, raw in files if raw and plain(raw, 4096)}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) == 4 and all(len(v) > 15 for v in want.values())


def test_shapes_and_bounds(tmp_path, spark):
    assert V.message(b'{"author": {"role": "user"}, "content": {"parts": ["a", "b"]}}') == ("user", "a\nb")
    assert V.message(b'{"sender": "human", "text": "x"}') == ("human", "x")
    for odd in (b'{"role": "user"}', b'{"content": "x"}', b'{"role": 5, "content": "x"}', b"[1]", b"{", b'{"role": "user", "content": "\xff"}'):
        assert V.message(odd) is None
    long = json.dumps({"role": "user", "content": ["x" * 500, {"role": "assistant", "content": "inner"}]}).encode()
    assert [x[2:] for x in V.objects(long, len(long), 200)] == [("assistant", "inner")]
    (tmp_path / "a.bin").write_bytes(b"\x00" + long + b"\x00")
    assert [r.role for r in V.load(spark, str(tmp_path)).collect()] == ["user"]
