"""The planned sources against plain parses: splits, filters, faults, streams."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from casegrid.sources import planned
from casegrid.sources.transcripts import EventStream, transcripts


@pytest.fixture(scope="module")
def formats(spark):
    planned.register(spark)
    return spark


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def filters(df):
    """Conditions that Spark itself still checks."""
    return " ".join(line for line in plan(df).splitlines() if " Filter " in line)


def whole_parse(data: bytes) -> dict:
    """The rules of a transcript on the whole body at once."""
    out = {"content": "", "events": 0, "malformed": 0, "complete": False, "usage": None}
    for line in data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if not line.startswith("data: "):
            continue
        body = line[6:].strip()
        if body == "[DONE]":
            out["complete"] = True
            break
        try:
            event = json.loads(body)
        except ValueError:
            out["malformed"] += 1
            continue
        out["events"] += 1
        out["content"] += event.get("choices", [{}])[0].get("delta", {}).get("content") or ""
        out["usage"] = event.get("usage")
    return out


def body(rng, tail):
    parts = [b'data: {"choices":[{"delta":{"role":"assistant"}}]}\n\n', b": keep-alive\r\n\r\n"]
    for text in ("Fièvre", " é", "你好", "\n", '"q"', " end"):
        parts.append(b"data: " + json.dumps({"choices": [{"delta": {"content": text}}]}, ensure_ascii=rng.random() < 0.5).encode() + rng.choice([b"\n\n", b"\r\n\r\n", b"\r\r"]))
    parts.append(b'data: {"choices":[{"delta":{}}],"usage":{"prompt_tokens":7,"completion_tokens":6},"timings":{"predicted_per_second":12.5}}\n\n')
    return b"".join(parts) + tail


TAILS = [b"data: [DONE]\n\n", b"data: [DONE]", b"", b'data: {"choi', b"data: nonsense\n\ndata: [DONE]\n\ndata: {}\n\n"]


@pytest.mark.parametrize("tail", TAILS)
def test_chunks_cut_anywhere(tail):
    rng = random.Random(3)
    data = body(rng, tail)
    want = whole_parse(data)
    for _ in range(200):
        cuts = sorted(rng.sample(range(1, len(data)), rng.randrange(1, 30)))
        stream = EventStream()
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)])):
            stream.feed(data[a:b], 10.0 * k)
        got = stream.row("t")
        assert {k: got[k] for k in ("content", "events", "malformed", "complete")} == {k: want[k] for k in ("content", "events", "malformed", "complete")}
        first_end = data.index(b"\n")
        assert got["ttft_ms"] == 10.0 * next(k for k, b in enumerate([*cuts, len(data)]) if b > first_end)
        assert (got["prompt_tokens"], got["gen_tok_per_sec"]) == (7, 12.5)


def records(name, data, size=11):
    return [json.dumps({"transcript": name, "at_ms": 5 * (k + 1), "chunk": base64.b64encode(data[i : i + size]).decode()}) for k, i in enumerate(range(0, len(data), size))]


def test_transcripts_batch_and_stream(formats, tmp_path):
    rng = random.Random(1)
    bodies = {f"t{k}": body(rng, TAILS[k % len(TAILS)]) for k in range(12)} | {"empty": b"", "none": b"hello\n"}
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "_SUCCESS").write_text("")
    names = list(bodies)
    for at in range(0, len(names), 5):
        (folder / f"part-{at}.json").write_text("\n".join(line for n in names[at : at + 5] for line in (records(n, bodies[n]) or records(n, b" "))) + "\n\n")
    want = {n: whole_parse(d) for n, d in bodies.items()}
    check = lambda rows: {r["transcript"]: (r["content"], r["events"], r["malformed"], r["complete"]) for r in rows} == {n: (w["content"], w["events"], w["malformed"], w["complete"]) for n, w in want.items()}
    load = formats.read.format("sse_transcripts").option("split_bytes", 1)
    rows = load.load(str(folder)).collect()
    assert len(rows) == len(want) and check(rows)
    one = load.load(str(folder)).where("transcript = 't3'")
    assert filters(one) == "" and [r["transcript"] for r in one.collect()] == ["t3"]

    def run():
        q = formats.readStream.format("sse_transcripts").load(str(folder)).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        q.awaitTermination()

    run()
    first = formats.read.parquet(str(tmp_path / "out")).count()
    assert first == len(want)
    (folder / "part-99.json").write_text("\n".join(records("late", bodies["t0"])) + "\n")
    run()
    after = formats.read.parquet(str(tmp_path / "out"))
    assert after.count() == first + 1 and after.where("transcript = 'late'").first()["content"] == want["t0"]["content"]
    with pytest.raises(ValueError, match="no record of a transcript"):
        list(transcripts([("f", 0, b'{"transcript": 1}')]))


def test_strict_lines_by_ranges(formats, tmp_path):
    rows = [{"case_id": str(k), "description": "é" * rng_len, "user": f"u{k % 3}"} for k, rng_len in enumerate(random.Random(2).choices(range(0, 400), k=300))]
    rows.append({"case_id": "long", "description": "x" * 3_000_000, "user": "u9"})
    (tmp_path / "a.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows[:150]))
    (tmp_path / "b.jsonl").write_text("\r\n".join(json.dumps(r, ensure_ascii=False) for r in rows[150:]) + "\n")
    (tmp_path / "empty.jsonl").write_text("")
    schema = "case_id string, description string, user string"
    for size in (40_009, 1 << 20):
        got = formats.read.format("case_lines").schema(schema).option("split_bytes", size).load(str(tmp_path))
        assert got.rdd.getNumPartitions() > 1
        assert sorted((r["case_id"], len(r["description"])) for r in got.collect()) == sorted((r["case_id"], len(r["description"])) for r in rows)
    (tmp_path / "s").mkdir()
    (tmp_path / "s/x.jsonl").write_text("\n".join(json.dumps(r) for r in rows[:12]))
    small = formats.read.format("case_lines").schema(schema).option("split_bytes", 61).load(str(tmp_path / "s"))
    assert sorted(r["case_id"] for r in small.collect()) == sorted(r["case_id"] for r in rows[:12])
    for f in (tmp_path / "s").iterdir():
        f.unlink()
    some = got.where("user = 'u1' and length(description) > 10")
    assert "length" in filters(some) and "u1" not in filters(some)
    assert some.count() == sum(r["user"] == "u1" and len(r["description"]) > 10 for r in rows)
    (tmp_path / "s/c.jsonl").write_text('{"case_id": "1"}\n\n{"case_id": \n')
    with pytest.raises(Exception, match=r"c\.jsonl:3: "):
        formats.read.format("case_lines").schema(schema).option("split_bytes", 5).load(str(tmp_path / "s")).collect()


def test_whole_files(formats, tmp_path):
    (tmp_path / "a.hl7").write_bytes("﻿MSH|^~\\&|A\rPID|é".encode())
    (tmp_path / "b.hl7").write_text("")
    assert [r["text"] for r in formats.read.format("hl7_messages").load(str(tmp_path)).collect()] == ["MSH|^~\\&|A\rPID|é"]
    (tmp_path / "c.hl7").write_bytes(b"MSH|\nPID|\xff")
    with pytest.raises(Exception, match=r"c\.hl7:2: not UTF-8"):
        formats.read.format("cda_reports").load(str(tmp_path)).collect()


def test_tickets(formats, tmp_path):
    rows = [(k, ["Processed", "Graylist", "Flagged", None][k % 4], f"p{k % 5}") for k in range(1000)]
    store = formats.createDataFrame(rows, "case_id long, queue_status string, patient string").repartition(3)
    store.write.option("parquet.block.size", "1024").parquet(str(tmp_path / "s"))
    load = lambda **o: formats.read.format("case_tickets").options(**o).load(str(tmp_path / "s"))
    ids = lambda df: sorted(r["case_id"] for r in df.collect())
    assert ids(load()) == [k for k, s, _ in rows if s != "Graylist"]
    assert ids(load(ticket="cases?status=Graylist")) == [k for k, s, _ in rows if s == "Graylist"]
    assert load(columns="case_id").columns == ["case_id"]
    some = load(ticket="cases?status=Flagged", batch_rows="7").where(F.col("patient").isin("p1", "p2") & (F.col("case_id") > 100))
    assert ids(some) == [k for k, s, p in rows if s == "Flagged" and p in ("p1", "p2") and k > 100]
    assert "case_id" in filters(some) and "patient" not in filters(some)
    with pytest.raises(Exception, match="unknown ticket"):
        load(ticket="people").collect()
