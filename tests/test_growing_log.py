"""Logs that grow between batches, and the ranges they are read in."""

import pytest

from bitledger.operators.engine import telemetry_summary
from bitledger.sources.engine import parse_telemetry
from bitledger.streaming import growing_log as gl
from bitledger.streaming.telemetry import read_summary, telemetry_stream_summary, write_summary


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "ab") as f:
        f.write(text.encode())


def test_a_file_appended_to_between_batches_gives_the_batch_summary(spark, tmp_path):
    lines = [f"RAM {900 + 7 * k % 50}/7620MB VDD_IN {4000 + k}mW/1mW GR3D_FREQ {k % 100}%" for k in range(50)]
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    log = tmp_path / "logs" / "Q4" / "tegra.log"

    def summary():
        stream = gl.stream_log(spark, f"{tmp_path}/logs/*/tegra.log")
        write_summary(telemetry_stream_summary(stream), out, checkpoint).awaitTermination()
        return read_summary(spark, out).collect()

    def batch(part):
        rows = [("Q4", k, x) for k, x in enumerate(part)]
        return telemetry_summary(parse_telemetry(spark.createDataFrame(rows, "label string, seq long, line string"))).collect()

    write(log, "\n".join(lines[:20]) + "\n" + lines[20][:9])
    assert summary() == batch(lines[:20])
    write(log, lines[20][9:] + "\n" + "\n".join(lines[21:40]) + "\n")
    assert summary() == batch(lines[:40])
    write(log, "\n".join(lines[40:]) + "\n")
    write(tmp_path / "logs" / "F16" / "tegra.log", "VDD_IN 10mW\n")
    found = {r.label: r for r in summary()}
    assert [found["Q4"]] == batch(lines) and found["F16"].avg_power_mw == 10.0


@pytest.mark.parametrize("size, read", [(1, 3), (7, 5), (16, 4096), (1000, 8)])
def test_ranges_hold_every_line_once(tmp_path, monkeypatch, size, read):
    monkeypatch.setattr(gl, "RANGE_BYTES", size)
    monkeypatch.setattr(gl, "_READ", read)
    texts = ["a", "", "long line " * 5, "ümläut", "x\r", "\rmiddle\rof", "", "end"]
    log = tmp_path / "a.log"
    write(log, "\n".join(texts) + "\nopen")
    for closed, want in ((False, texts), (True, [*texts, "open"])):
        reader = gl.GrowingLogReader(str(log), closed)
        end = reader.latestOffset()
        rows = [
            (o, line)
            for part in reader.partitions(reader.initialOffset(), end)
            for batch in reader.read(part)
            for o, line in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        ]
        assert [line for _, line in sorted(rows)] == [x.rstrip("\r") for x in want]
        raw = log.read_bytes()
        assert all(raw[o:].startswith(line.encode()) for o, line in rows)
        assert reader.latestOffset() == end and not reader.partitions(end, end)


def test_restart_and_shrinking(tmp_path):
    for name in "ba":
        write(tmp_path / f"{name}.log", f"{name}1\n")
    first = gl.GrowingLogReader(f"{tmp_path}/*.log", False)
    seen = first.latestOffset()
    write(tmp_path / "a.log", "a2\n")
    write(tmp_path / "c.log", "c1\n")
    again = gl.GrowingLogReader(f"{tmp_path}/*.log", False)
    end = again.latestOffset()
    rows = [x for p in again.partitions(seen, end) for b in again.read(p) for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    assert rows == [(3, "a2"), (0, "c1")]
    (tmp_path / "a.log").write_text("")
    with pytest.raises(ValueError):
        again.latestOffset()
    later = gl.GrowingLogReader(f"{tmp_path}/*.log", False)
    with pytest.raises(ValueError):
        later.partitions(end, later.latestOffset())
    assert gl.GrowingLogReader(f"{tmp_path}/none/*.log", False).latestOffset() == {"files": "{}"}
