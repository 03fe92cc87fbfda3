"""The blob ledger against Python's re over every path of every commit."""

import hashlib
import re

import pytest

from provenir.llm import secrets
from provenir.session import scratch_path
from tests.compare import connect, rows_of

HEX = "0123456789abcdef" * 2
TEXTS = [
    None, "", "plain words", 'token = "abc" token: secret', f"ä😀 PASSWORD={HEX} é API_KEY:'xyz_12.=/+'", f"passwd=short1 AKIA{'Z' * 16} AKIAZZ", f"{HEX}{HEX}\n{HEX[:23]} {HEX[:24]}",
    "token=token=abcdef apikey==abcdef", "ſecret=abcdefgh toKen=abcdefgh", "-----BEGIN RSA PRIVATE KEY----- x", "eyJh.eyJb.c-_", "ghp_" + "a1" * 18, "https://me:pass@host/x", "token=" * 400,
    "x" * 50_000 + " secret: 'value1'" + "\x1f" + "y" * 1000, "a1b2 " * 3000 + HEX,
]


def spans(text, rules=secrets.BASE_RULES + secrets.ADDED_RULES):
    text, out = text or "", []
    for rule in rules:
        ascii_only = rule.pattern.replace("(?i:", "(?ai:") if "(?i:" in rule.pattern else rule.pattern
        for m in re.finditer(ascii_only, text):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), secrets.KINDS.index(rule.kind), m.end(), rule.kind))
    return sorted(out)


def files(spark, texts, extra=()):
    rows = [(f"f{i}", t, "k", "c", b"b", 1) for i, t in enumerate(texts)] + [(p, t, "k", "c", b"b", 1) for p, t in extra]
    return spark.createDataFrame(rows, "path string, text string, kind string, commit string, blob binary, start int")


def by_path(ledger, rules=None):
    found = ledger.spans_by_path() if rules is None else ledger.spans_by_path(rules)
    return sorted((r.commit, r.path or "", [tuple(s) for s in r.spans]) for r in found.collect())


@pytest.mark.parametrize("broadcast", [True, False])
def test_history_is_scanned_once(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(secrets, "MAX_BROADCAST_KEYS", 0)
        monkeypatch.setattr(secrets, "SHARED_PATHS", 2)
    ledger = secrets.BlobLedger(spark, scratch_path(spark, "ledger"))
    extra = [(f"copy{i}", TEXTS[4]) for i in range(9)] + [(None, TEXTS[6]), ("f3", TEXTS[3])]
    ledger.commit(0, files(spark, TEXTS, extra).repartition(3))
    ledger.commit(0, files(spark, ["never taken"]))
    blobs = len({t or "" for t in TEXTS})
    assert ledger.scan(secrets.BASE_RULES) == 3 * blobs
    assert ledger.scan(secrets.BASE_RULES) == 0
    want = [(0, f"f{i}", spans(t)) for i, t in enumerate(TEXTS)] + [(0, p or "", spans(t)) for p, t in extra]
    assert by_path(ledger, secrets.BASE_RULES) == sorted((c, p, [s for s in found if s[1] < 3]) for c, p, found in want)
    # New rules run alone, on every blob; old pairs stay settled.
    assert ledger.scan() == len(secrets.ADDED_RULES) * blobs
    # A later version: one text changed, one new, one back from another path, the rest as before.
    later = [*TEXTS[:5], "secret=changed1", *TEXTS[6:], f"new {HEX}", TEXTS[9]]
    ledger.commit(1, files(spark, later))
    assert ledger.scan() == 2 * len(secrets.KINDS)
    want += [(1, f"f{i}", spans(t)) for i, t in enumerate(later)]
    assert by_path(ledger) == sorted(want)
    assert ledger.history.read()["blobs"].count() == blobs + 2
    flat = sorted((r.commit, r.path or "", r.start, r.end, r.kind) for r in ledger.findings_by_path().collect())
    assert flat == sorted((c, p, s[0], s[2], s[3]) for c, p, found in want for s in found)


def test_a_new_rule_version_runs_alone(spark):
    ledger = secrets.BlobLedger(spark, scratch_path(spark, "ledger"))
    ledger.commit(0, files(spark, TEXTS))
    ledger.scan(secrets.BASE_RULES)
    longer = secrets.Rule("hex", r"[0-9a-f]{60,}", version=2)
    rules = (*secrets.BASE_RULES[:2], longer)
    assert ledger.scan(rules) == len({t or "" for t in TEXTS})
    want = [(0, f"f{i}", spans(t, rules)) for i, t in enumerate(TEXTS)]
    assert by_path(ledger, rules) == sorted(want)
    with pytest.raises(ValueError):
        ledger.scan((longer, longer))


def test_nothing_to_scan(spark):
    ledger = secrets.BlobLedger(spark, scratch_path(spark, "ledger"))
    ledger.commit(0, files(spark, []))
    assert ledger.scan() == 0 and by_path(ledger) == []


def test_scans_stay_with_spark(spark, sf_dir):
    """No Python on the executors."""
    from provenir.llm.queries import QUERIES

    ledger = secrets.BlobLedger(spark, scratch_path(spark, "ledger"))
    ledger.commit(0, files(spark, TEXTS))
    plan = secrets.find_spans(ledger.unseen(secrets.BASE_RULES).join(ledger.history.read()["blobs"], "blob"), secrets.BASE_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "Python" not in QUERIES["op12_secret_scan"](spark, sf_dir)._jdf.queryExecution().toString()


def test_query_against_re_and_sql(spark, sf_dir):
    from provenir.llm.queries import ORACLES, QUERIES

    df = QUERIES["op12_secret_scan"](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = connect(sf_dir)
    cur = con.execute(ORACLES["op12_secret_scan"])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
    want = {}
    for doc, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        found = spans(text)
        base = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in found if s[1] < 3)
        want[doc] = (hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in found))
    assert {r.doc_id: (r.base_sha256, r.spans) for r in df.collect()} == want
