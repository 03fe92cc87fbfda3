"""Scalar expressions against the Python standard library."""

import hashlib
import json
import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from provenir.functions import hashing, text, times

STRINGS = [
    "",
    "plain",
    'quote " and \\ backslash',
    "tab\tline\nreturn\rbell\x07 del\x7f nul\x00 \x08\x0c\x1f",
    "grüße — déjà",
    "emoji 😀 and 𝒳 end",
    "﻿bom ‮ rtl",
    "/slash/ <tag> & '",
]


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def test_json_text_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in STRINGS], "s string")
    for row in df.select("s", hashing.json_text(F.col("s")).alias("j")).collect():
        assert row.j == json.dumps(row.s, ensure_ascii=True)


def test_event_id_matches_python(spark):
    rows = [
        (s, {s: "v", "k": s, "a\"b": "😀", "Z": "", "é": "1"}, [s or "x", "e2"]) for s in STRINGS
    ]
    df = spark.createDataFrame(rows, "t string, a map<string,string>, d array<string>")
    got = df.select("t", "a", "d", hashing.event_id(F.col("t"), F.col("a"), F.col("d")).alias("id"))
    for r in got.collect():
        doc = {"_type": "NormalizedEvent", "event_type": r.t, "attributes": r.a, "derived_from": r.d}
        assert r.id == hashlib.sha256(canonical(doc).encode()).hexdigest()


def test_assertion_id_and_timestamp_text(spark):
    stamps = [
        datetime(2026, 1, 1, 8, 30, tzinfo=UTC),
        datetime(2026, 1, 1, 8, 30, 0, 500000, tzinfo=UTC),
        datetime(1969, 12, 31, 23, 59, 59, 1, tzinfo=UTC),
        datetime(1999, 5, 6, 1, 2, 3, 120, tzinfo=UTC),
    ]
    df = spark.createDataFrame([(t,) for t in stamps], "v timestamp")
    got = df.select(
        times.micros(F.col("v")).alias("us"),
        times.canonical_timestamp(F.col("v")).alias("text"),
        hashing.assertion_id(F.lit("e"), F.col("v"), F.lit("second"), F.lit("x"), F.lit("a")).alias("id"),
    ).collect()
    by_us = {r.us: r for r in got}
    for t in stamps:
        us = (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
        want = t.isoformat().replace("+00:00", "Z")
        assert by_us[us].text == want
        doc = {
            "_type": "TimeAssertion",
            "subject_event_id": "e",
            "value": want,
            "precision": "second",
            "source_evidence_id": "x",
            "asserted_by": "a",
        }
        assert by_us[us].id == hashlib.sha256(canonical(doc).encode()).hexdigest()


def test_gap_finding_id_keeps_nulls(spark):
    t = datetime(2026, 1, 1, tzinfo=UTC)
    row = spark.createDataFrame([(t,)], "t timestamp").select(
        hashing.gap_finding_id(
            F.lit("a"), F.lit("b"), F.lit(None).cast("string"), F.lit(""), F.col("t"), F.col("t"),
            F.array(F.lit("x")), F.array(F.lit("p"), F.lit("q")),
        ).alias("id")
    ).first()
    doc = {
        "_type": "GapFinding", "absent_source": "a", "present_source": "b",
        "absent_source_refinement": None, "present_source_refinement": "",
        "interval_start": "2026-01-01T00:00:00Z", "interval_end": "2026-01-01T00:00:00Z",
        "corroborating_time_assertion_ids": ["x"], "bounding_absent_assertion_ids": ["p", "q"],
    }
    assert row.id == hashlib.sha256(canonical(doc).encode()).hexdigest()


def _iso_samples():
    rng = random.Random(7)
    dates = ["2026-01-15", "20260115", "2026-W03-4", "2026W034", "2026-W03", "2026W03", "2024-02-29",
             "2023-02-29", "2026-13-01", "2026-00-10", "2026-W53-1", "2020-W53-7", "2026-W00-1",
             "0000-01-01", "0001-01-02", "9999-12-30", "2026-0115", "2026-01-32", "2026-W03-8"]
    seps = ["T", " ", "é", "t", "_"]
    clocks = ["09", "09:00", "0900", "09:00:01", "090001", "09:00:01.5", "09:00:01,123456789", "09:00:01.",
              "24:00", "23:59:60", "09:61", "0900:01", "09:0001", "9:00", "09.25", "09:00.75", "",
              "09:00:00 ", "09:00:00x", "09:", "09:00:00.1234567x", "09:00:00.5x", "09\n", "09é", "090"]
    zones = ["Z", "z", "+00:00", "-05:30", "+0130", "+01", "+23:59", "-23:59:59.999999", "+24:00",
             "+01:30:15", "+0130:15", "+01:60", "", " +01:00", "UTC", "+1:00", "+18:30", "+01:30.5", "+01x", "+01:", "Z+01:00", "+01:00:00."]
    out = {f"{d}{s}{c}{z}" for d in dates[:6] for s in seps[:2] for c in clocks for z in zones}
    for _ in range(3000):
        out.add(rng.choice(dates) + rng.choice(seps) + rng.choice(clocks) + rng.choice(zones))
    out |= {"", "not a time", "2026-01-15", "2026-01-15T09:00:00Z\n", "\n2026-01-15T09:00:00Z"}
    return sorted(out)


def test_parse_iso_matches_python(spark):
    samples = _iso_samples()
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = {r.s: r.us for r in df.select("s", times.micros(times.parse_iso(F.col("s"))).alias("us")).collect()}
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    wrong = []
    for s in samples:
        try:
            value = datetime.fromisoformat(s)
            want = None if value.tzinfo is None else (value - epoch) // timedelta(microseconds=1)
        except ValueError:
            want = None
        if got[s] != want:
            wrong.append((s, got[s], want))
    assert not wrong, wrong[:20]


def test_neutralize_is_visible_and_injective(spark):
    hidden = set(text.HIDDEN_CODE_POINTS)
    samples = STRINGS + ["​", "\\u200B", "a\\b", "\x00\x01", "\t\n"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = {r.s: r.n for r in df.select("s", text.neutralize(F.col("s")).alias("n")).collect()}
    for s in samples:
        want = "".join(
            f"\\u{ord(ch):04X}" if ord(ch) in hidden else ch for ch in s.replace("\\", "\\\\")
        )
        assert got[s] == want
    assert len(set(got.values())) == len(set(samples))
    assert len(hidden) == 48


def test_source_id_rules(spark):
    samples = {"host1": True, "": False, " a": False, "a ": False, "a b": True, "x" * 256: True,
               "x" * 257: False, "a​b": False, "a\x1fb": False, "a\tb": True}
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = {r.s: r.p is None for r in df.select("s", text.source_id_problem(F.col("s")).alias("p")).collect()}
    assert got == samples


def test_hash_mod3(spark):
    ids = [f"p{i}" for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids], "s string")
    for r in df.select("s", hashing.hash_mod3(F.col("s")).alias("m")).collect():
        assert r.m == int(hashlib.sha256(r.s.encode()).hexdigest(), 16) % 3


def test_disagreement_is_strict(spark):
    t = datetime(2026, 1, 1, tzinfo=UTC)
    rows = [(t, "second", t + timedelta(seconds=2), "second", False),
            (t, "second", t + timedelta(seconds=2, microseconds=1), "second", True),
            (t, "exact", t, "exact", False), (t, "day", t - timedelta(days=2), "exact", True)]
    df = spark.createDataFrame(rows, "a timestamp, pa string, b timestamp, pb string, want boolean")
    for r in df.withColumn("got", times.disagrees(F.col("a"), F.col("pa"), F.col("b"), F.col("pb"))).collect():
        assert r.got == r.want
