"""Captures read back in chunks."""

import numpy as np

from aeroband.sources import captures


def test_chunks_leave_in_batches(spark, tmp_path, monkeypatch):
    """A frame made for every chunk took most of the time; an unreadable file is still one row."""
    rng = np.random.default_rng(2)
    want = {}
    for name in ("a.iq", "b.iq"):
        values = rng.normal(size=2 * 1003).astype(np.float32)
        (tmp_path / name).write_bytes(values.tobytes())
        want |= {(name, k): (values[2 * k:2 * k + 20:2].tolist(), values[2 * k + 1:2 * k + 20:2].tolist()) for k in range(0, 1003, 10)}
    (tmp_path / "bad.npy").write_bytes(b"\x93NUMPY broken")
    made = []
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda df, fn, schema: made.append((df.toPandas(), fn)) or df)
    captures.build_frames(spark, str(tmp_path), "complex64", chunk=10, chunks_per_task=3)
    monkeypatch.undo()
    ranges, run = made[0]
    frames = list(run(iter([ranges])))
    rows = [r for f in frames for r in f.itertuples(index=False, name=None)]
    assert len(frames) == 1 and len(rows) == len(want) + 1
    got = {(p.rsplit("/", 1)[1], offset): (i.tolist(), q.tolist()) for p, k, offset, i, q, error in rows if error is None and k == offset // 10}
    assert got == want
    spark_rows = captures.build_frames(spark, str(tmp_path), "complex64", chunk=10, chunks_per_task=3).collect()
    assert {(r.path.rsplit("/", 1)[1], r.sample_offset): (list(r.i), list(r.q)) for r in spark_rows if r._error is None} == want
    assert [r.path.rsplit("/", 1)[1] for r in spark_rows if r._error is not None] == ["bad.npy"]
