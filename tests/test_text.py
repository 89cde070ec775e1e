import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sigmill.functions import identity, text
from sigmill.functions.vectors import cosine, decode, encode, hashed_embedding, is_valid, normalized
from sigmill.sources import allowlist, listed


@pytest.mark.parametrize(
    ("value", "kinds"),
    [
        ("010-1234-5678 로 연락", ["PHONE"]),
        ("02-123-4567 전화", ["PHONE"]),
        ("1588-1234 전화", ["PHONE"]),
        ("a.b@c.co 메일", ["EMAIL"]),
        ("1234-5678-1234-5678 카드", ["CARD"]),
        ("1234567890123 계좌", ["ACCOUNT"]),
        ("110-234-567890 계좌", ["ACCOUNT"]),
        ("123456789 아홉 자리", []),
        ("123456789012345 열다섯", []),
        ("26-09-29 날짜", []),
        ("2026-08-15 날짜", []),
        ("26-19-39 아님", ["ACCOUNT"]),
    ],
)
def test_mask_kinds(value, kinds):
    decision, masked, found, spans, residual = text.scan_text(value)
    assert found == kinds and decision == ("MASKED" if kinds else "ALLOW") and not residual
    assert all(f"[{k}]" in masked for k in kinds)


@pytest.mark.parametrize("value", ["901010-1234567 번호", "OTP: 123456", "비밀번호는 abcd1234"])
def test_refused(value):
    assert text.scan_text(value)[0] == "REJECT"


def test_scan_columns(spark):
    df = spark.createDataFrame([(1, "a.b@c.co 와 010-1234-5678"), (2, None), (3, "OTP 123456"), (4, "")], "id int, t string")
    rows = {r.id: r for r in df.withColumn("s", text.scan(F.col("t"))).withColumn("r", text.reject_kinds(F.col("t"))).collect()}
    assert rows[1].s.masked == "[EMAIL] 와 [PHONE]" and rows[1].s.kinds == ["EMAIL", "PHONE"]
    assert rows[2].s is None or rows[2].s.decision is None
    assert rows[3].s.decision == "REJECT" and rows[3].r == ["OTP"] and rows[4].s.decision == "ALLOW"


def test_normalize_bounds(spark):
    rows = [(1, " " + "가" * 20 + "\n"), (2, "가" * 19), (3, "a" * 500), (4, "a" * 501), (5, "é" * 20 + "[이메일]"), (6, None)]
    got = {r.id: r.n for r in spark.createDataFrame(rows, "id int, t string").select("id", text.normalize(F.col("t")).alias("n")).collect()}
    assert got[1] == "가" * 20 and got[2] is None and len(got[3]) == 500 and got[4] is None and got[5] == "é" * 20 + "[EMAIL]" and got[6] is None


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("quote", "expected"),
    [("2026년 8월 15일 오후 3시 20분", True), ("26-09-28 23:33", True), ("2026.08.15 9시", True), ("26/08/15 10:05", True), ("8월 15일 3시", False), ("2026-08-15", False), ("2026-08-15 23:89", False)],
)
def test_date_and_time(spark, quote, expected):
    assert one(spark, text.names_date_and_time(F.lit(quote))) is expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("2026년 8월 15일 오후 3시 20분", "2026-08-15T15:20:00+09:00"),
        ("26-09-28 23:33에", "2026-09-28T23:33:00+09:00"),
        ("2026.08.05 오전 12시", "2026-08-05T00:00:00+09:00"),
        ("오후 3시", None),
        ("2026-08-15", None),
    ],
)
def test_occurred_at(spark, value, expected):
    assert one(spark, text.occurred_at(F.lit(value))) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("로그인이 안 됩니다", "LOGIN_ACCESS_FAILURE"),
        ("와이파이에서 오류", "DEVICE_NETWORK_SUSPECTED"),
        ("와이파이는 정상인데 로그인 실패", "LOGIN_ACCESS_FAILURE"),
        ("주문이 접수됐는지 모르겠어요", "ORDER_RESULT_UNCONFIRMED"),
        ("잔고 오류", "BALANCE_INQUIRY_ERROR"),
        ("주문 버튼이 무반응", "ORDER_SUBMISSION_FAILURE"),
        ("수수료가 궁금합니다", "UNRELATED_OR_AMBIGUOUS"),
        ("안녕하세요", None),
    ],
)
def test_issue_candidate(spark, value, expected):
    assert one(spark, text.issue_candidate(F.lit(value))) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), (' {"a": {"b": 2}} ', '{"a": {"b": 2}}'), ('말 {"a": "}{"} 끝 {', '{"a": "}{"}'), ("없음", None), ('{"a": "', None)],
)
def test_json_object(spark, value, expected):
    assert one(spark, text.json_object(F.lit(value))) == expected


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, cosine(a, a)) == 1.0 and one(spark, cosine(a, z)) == 0.0 and one(spark, cosine(a, F.array(F.lit(1.0)))) is None
    assert one(spark, normalized(a)) == [0.6, 0.8] and one(spark, normalized(z)) == [0.0, 0.0]
    assert one(spark, decode(encode(a))) == [3.0, 4.0]
    assert not one(spark, is_valid(z, 2)) and not one(spark, is_valid(F.array(F.lit(float("nan")), F.lit(1.0)), 2)) and one(spark, is_valid(a, 2))
    assert abs(sum(x * x for x in one(spark, hashed_embedding(F.lit("a b c"), 8))) - 1) < 1e-9


def test_keyed_digest(spark):
    import base64
    import hmac

    assert bytes(one(spark, identity.keyed_digest(F.lit("é"), b"k", "ns"))) == hmac.digest(b"k", "ns\0é".encode(), "sha256")
    assert one(spark, identity.reference_number(F.lit("v"), b"k")) == base64.b32encode(hmac.digest(b"k", b"v", "sha256")[:16]).decode().rstrip("=")


HEADER = "단축코드,한글 종목약명,시장구분,주식종류\n"
BODY = "005930,삼성,KOSPI,보통주\n000660,하이,KOSDAQ GLOBAL,보통주\n005935,우선,KOSPI,우선주\n900001,코넥,KONEX,보통주\n"


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-8", "cp949"])
def test_allowlist_encodings(encoding):
    error, _, rows = allowlist.parse((HEADER + BODY).encode(encoding))
    assert error is None and [(r[0], r[2]) for r in rows] == [("000660", "KOSDAQ"), ("005930", "KOSPI")]


@pytest.mark.parametrize(
    ("content", "error"),
    [
        ("단축코드,시장구분\n1,2\n", "MISSING_COLUMN"),
        ("단축코드,단축코드,한글 종목약명,시장구분,주식종류\n", "DUPLICATE_COLUMN"),
        (HEADER + "005930,삼성,KOSPI,보통주\n005930,삼성,KOSPI,보통주\n", "DUPLICATE_CODE"),
        (HEADER + "5930,삼성,KOSPI,보통주\n", "BAD_VALUE"),
        (HEADER + "005930,,KOSPI,보통주\n", "BAD_VALUE"),
        (HEADER, "EMPTY"),
    ],
)
def test_allowlist_refuses(content, error):
    assert allowlist.parse(content.encode())[0] == error


def page(items, total, result="00"):
    return json.dumps({"response": {"header": {"resultCode": result}, "body": {"totalCount": total, "items": {"item": items}}}}, ensure_ascii=False)


def listing(code, name="이름", market="KOSPI", day="20260801"):
    return {"basDt": day, "srtnCd": code, "mrktCtg": market, "itmsNm": name}


def test_listed_pages_read_as_a_source(spark, tmp_path):
    one, two, three = listing("A000001"), listing("A000002", " \u1112\u1161\u11ab "), listing(" a000003 ", market="KOSDAQ")
    other = listing("A000004", market="KONEX")
    cases = {
        "sound": ([page([one, two], 4), page([three, other], 4)], None),
        "lone": ([page(one, 1)], None),
        "rejected": ([page([one], 1, "30")], "REQUEST_REJECTED"),
        "broken": (["{"], "INVALID_RESPONSE"),
        "negative": ([page([one], -1)], "INVALID_TOTAL"),
        "shapeless": ([page("text", 1)], "INVALID_ITEMS"),
        "badcode": ([page([listing("A0001")], 1)], "BAD_ITEM"),
        "nameless": ([page([listing("A000001", "  ")], 1)], "BAD_ITEM"),
        "badday": ([page([listing("A000001", day="20261341")], 1)], "BAD_BASIS_DATE"),
        "changed": ([page([one], 2), page([two], 3)], "TOTAL_CHANGED"),
        "short": ([page([one], 3), page([two], 3)], "INCOMPLETE"),
        "twice": ([page([one, one], 2)], "DUPLICATE_CODE"),
        "late": ([page([one, listing("A000009", day="20260731")], 2)], "OTHER_BASIS_DATE"),
        "none": ([page([other], 1)], "NO_SYMBOLS"),
        "large": ([page([one], 1) + " " * listed.MAX_BYTES], "PAGE_TOO_LARGE"),
        "many": ([page([listing(f"A{i:06}")], 101) for i in range(101)], "TOO_MANY_PAGES"),
    }
    for name, (bodies, _) in cases.items():
        for i, body in enumerate(bodies, 1):
            (tmp_path / f"{name}-{i}.json").write_text(body)
    spark.dataSource.register(listed.ListedPages)
    rows = spark.read.format("listed_pages").option("path", str(tmp_path)).load()
    assert rows.rdd.getNumPartitions() == sum(len(b) for b, _ in cases.values())
    found = listed.faults(rows, F.to_date(F.lit("2026-08-01")))
    assert {r.source: r.fault for r in found.collect()} == {n: f for n, (_, f) in cases.items()}
    kept = listed.snapshot(rows, found)
    assert {(r.source, r.code, r.market, r.name) for r in kept.collect()} == {
        ("sound", "000001", "KOSPI", "이름"), ("sound", "000002", "KOSPI", "한"), ("sound", "000003", "KOSDAQ", "이름"), ("lone", "000001", "KOSPI", "이름"),
    }
    whole = json.dumps([{"code": "000001", "market": "KOSPI", "name_ko": "이름", "source_as_of": "2026-08-01"}], ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert {r.source: r.sha256 for r in listed.digest(kept).collect()}["lone"] == hashlib.sha256(whole.encode()).hexdigest()
    table = spark.createDataFrame([(n, i, b) for n, (bodies, _) in cases.items() for i, b in enumerate(bodies, 1)], "source string, page int, body string")
    assert sorted(map(str, listed.items(table).collect())) == sorted(map(str, rows.collect()))


def test_embeddings_of_documents_equal_a_plain_form(spark, sf_dir):
    import re

    import numpy as np
    import xxhash

    from sigmill.plans.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.vector for r in QUERIES["embed_text"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, text_ in texts.items():
        want = np.zeros(16)
        for word in re.split(r"[ \t\n\x0b\f\r]+", (text_ or "").strip(" ").lower()):
            slot = int(np.uint64(xxhash.xxh64_intdigest(word.encode(), 42)).astype(np.int64)) % 32
            want[slot % 16] += 1 if slot < 16 else -1
        size = np.linalg.norm(want)
        assert [float(x) for x in got[i].split(",")] == pytest.approx(want / size if size else want, abs=2e-6), i


def test_embedding_of_a_long_text_takes_one_pass(spark):
    """The texts' words are cut and hashed once; null and blank texts keep their rows."""
    import time

    from sigmill.functions.vectors import hashed_embedding

    rows = [(1, "word other " * 200_000), (2, None), (3, ""), (4, "word")]
    df = spark.createDataFrame(rows, "k int, text string").select("k", hashed_embedding(F.col("text"), 16).alias("v"))
    began = time.perf_counter()
    got = {r.k: r.v for r in df.collect()}
    assert time.perf_counter() - began < 20
    assert got[2] == [None] * 16
    assert [sum(x * x for x in got[k]) for k in (1, 3, 4)] == pytest.approx([1, 1, 1])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1
