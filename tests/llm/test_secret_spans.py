"""Secret spans against scanners that walk over the text, and the ledger over several runs."""

import hashlib
import random
import string

from pyspark.sql import functions as F

from adlumen.llm import queries, secrets

KEY_LETTERS = string.ascii_letters + string.digits + "+/_.=-"
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")  # longer names first where one begins another


def runs(text, letters):
    start = None
    for i, c in enumerate(text + "\0"):
        if c in letters and c != "\0":
            start = i if start is None else start
        elif start is not None:
            yield start, i
            start = None


def assign_at(text, i):
    """End of value and its length for an assignment that starts at ``i``."""
    for name in NAMES:
        if all(j < len(text) and text[j] in (c, c.upper()) for j, c in enumerate(name, i)):
            ends = [i + len(name)]
            if text[ends[0]:ends[0] + 1] in ('"', "'") and text[ends[0]:ends[0] + 1]:
                ends = [ends[0] + 1]
            at = ends[0]
            while text[at:at + 1] == " ":
                at += 1
            if text[at:at + 1] not in (":", "=") or not text[at:at + 1]:
                continue
            at += 1
            while text[at:at + 1] == " ":
                at += 1
            if text[at:at + 1] and text[at] in "\"'":
                at += 1
            end = at
            while end < len(text) and text[end] in KEY_LETTERS:
                end += 1
            if end > at:
                return end, end - at
    return None


def brute(text):
    found, at = [], 0
    while at < len(text):
        hit = assign_at(text, at)
        if hit:
            if hit[1] >= 6:
                found.append((at, 0, hit[0]))
            at = hit[0]
        else:
            at += 1
    at = 0
    while (start := text.find("AKIA", at)) >= 0:
        end = start + 4
        while end < len(text) and text[end] in string.ascii_uppercase + string.digits:
            end += 1
        if end - start >= 20:
            found.append((start, 1, end))
        at = end if end > start + 4 else start + 1
    found += [(a, 2, b) for a, b in runs(text, "0123456789abcdef") if b - a >= 24]
    kinds = ("assign", "access", "hex")
    return [(kinds[k], a, b) for a, k, b in sorted(found)]


def base_of(found):
    return [(f.kind, f.start, f.end) for f in found if f.kind in ("assign", "access", "hex")]


def test_spans_equal_a_walk_over_made_texts(spark, tmp_path):
    rng = random.Random(4)
    parts = ["password", "Token", "API_KEY", "apikey", "apiKey", "secret", "passwd", '"', "'", " ", "  ", ":", "=", "==", "\t", "\n", "AKIA", "AKI",
             "ABCDEFGH12345678", "0123456789abcdef01234567", "deadbeef", "f" * 24, "abcdef", "x.y/z+", "é", "\U0001f600", "ſecret", "-", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "a" * 100_000, "token=" + "A" * 50_000, "AKIA" * 20, "password = 'password = hunter22'"]
    docs = spark.createDataFrame([(i % 900 if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns(
        {"blob": F.lit("clash"), "findings": F.lit(1), "rules": F.lit(None).cast("string")})
    got = secrets.findings(docs, str(tmp_path / "ledger")).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    expected = [(i % 900 if i % 7 else None, digest(t), brute(t or "")) for i, t in enumerate(texts)]
    assert sorted([(r.doc_id, r.blob, base_of(r.findings)) for r in got], key=repr) == sorted(expected, key=repr)


def test_query_equals_a_walk_over_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.registered()["op8_secret_scan"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        spans = brute(d.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        row = got[d.doc_id]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex"))
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))


def test_versions_scanned_over_several_runs_equal_one_run(spark, tmp_path):
    """A ledger that is filled version by version gives what one run over all versions gives, and scans each content once."""
    rows = [(path, version, f"token = abc{path // 3}def{version % 2}") for path in range(30) for version in range(4)]
    versions = spark.createDataFrame(rows, "doc_id long, version int, text string")
    filled, fresh = str(tmp_path / "filled"), str(tmp_path / "fresh")
    sizes = []
    for version in range(4):
        secrets.findings(versions.where(F.col("version") <= version), filled).count()
        sizes.append(spark.read.parquet(filled).count())
    assert sizes == [10, 20, 20, 20]
    plain = lambda df: sorted((r.doc_id, r.blob, tuple(map(tuple, r.findings))) for r in df.collect())
    assert plain(secrets.findings(versions, filled)) == plain(secrets.findings(versions, fresh))
