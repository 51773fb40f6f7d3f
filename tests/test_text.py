import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioscope.functions import hashing
from folioscope.functions import text as tx

T = "ـ"


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    ("raw", "policy", "expected"),
    [
        ("شماره قرارداد ١٢٣٤٥ ABC-42 https://example.com", tx.Normalization(), "شماره قرارداد ۱۲۳۴۵ ABC-42 https://example.com"),
        (f"کيک 123{T}", tx.Normalization(remove_tatweel=True, digits="ascii"), "کیک 123"),
        ("١٢٣", tx.Normalization(digits="preserve"), "١٢٣"),
        ("۱۲۳", tx.Normalization(digits="arabic"), "١٢٣"),
        ("١٢٣", tx.Normalization(digits="arabic"), "١٢٣"),  # identity: mapping to ASCII would not be idempotent
        ("شماره ١٢٣ ID-42 ABC-42 2024-01-02 https://example.com/items/42 mail@example.com", tx.Normalization(), "شماره ۱۲۳ ID-42 ABC-42 2024-01-02 https://example.com/items/42 mail@example.com"),
        (" متن‌​  اول\r\n\tدوم ", tx.Normalization(digits="preserve", whitespace="collapse", line_breaks="space", zero_width="remove"), "متن اول دوم"),
        ("é\x1c", tx.Normalization(), "é"),
        ("", tx.Normalization(), ""),
        ("😀 7", tx.Normalization(), "😀 ۷"),
    ],
)
def test_normalize(spark, raw, policy, expected):
    assert one(spark, [(raw,)], "t string", tx.normalize(F.col("t"), policy)) == [(expected,)]


def test_normalize_is_idempotent_and_keeps_null(spark):
    rows = [("a١ b-2 ۳",), (None,), ("‌x",)]
    once = tx.normalize(F.col("t"))
    got = one(spark, rows, "t string", once.alias("a"), tx.normalize(once).alias("b"))
    assert all(a == b for a, b in got) and got[1] == (None, None)


def test_invalid_policy():
    with pytest.raises(ValueError):
        tx.Normalization(digits="roman")


@pytest.mark.parametrize(
    ("left", "right", "expected"),
    [
        ("شماره قرارداد ١٢٣٤٥", "شماره قرارداد ۱۲۳۴۵", {"normalized_equal": True, "edit_distance": 5}),
        ("شماره ۱۲۳٤", "شماره ۱۲۴٤", {"digit_only": True, "edit_distance": 1}),
        ("Invoice: A-12", "Invoice A-12", {"punctuation_only": True}),
        ("A  B", "A B", {"whitespace_only": True}),
        ("ایمیل: user@example.com", "ایمیل: user@example.coм", {"normalized_equal": False, "edit_distance": 1}),
        ("", "", {"exact": True, "cer_like": 0.0}),
    ],
)
def test_compare(spark, left, right, expected):
    d = spark.createDataFrame([(left, right)], "a string, b string").select(tx.compare(F.col("a"), F.col("b")).alias("d")).head().d
    assert {k: d[k] for k in expected} == expected
    kinds = [k for k in ("digit_only", "punctuation_only", "whitespace_only") if d[k]]
    assert kinds == [k for k in expected if k.endswith("_only")]


def wer_of(p, r):
    p, r = p.split(), r.split()
    if not r:
        return 1.0 if p else 0.0
    row = list(range(len(r) + 1))
    for i, a in enumerate(p, 1):
        now = [i]
        for j, b in enumerate(r, 1):
            now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = now
    return row[-1] / len(r)


def test_error_rates_against_a_plain_version(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("ab ç") for _ in range(rnd.randrange(0, 4)))
    rows = [(" ".join(word() for _ in range(rnd.randrange(0, 9))), " ".join(word() for _ in range(rnd.randrange(0, 9)))) for _ in range(60)] + [("", ""), ("a", "")]
    got = one(spark, rows, "p string, r string", "p", "r", tx.wer(F.col("p"), F.col("r")), tx.cer(F.col("p"), F.col("r")))
    for p, r, wer, cer in got:
        assert wer == pytest.approx(wer_of(p, r))
        letters = wer_of(" ".join(f"c{ord(c)}" for c in p), " ".join(f"c{ord(c)}" for c in r))
        assert cer == pytest.approx(letters)


def test_word_codes_do_not_wrap_round(spark):
    names = [f"w{k}" for k in range(1 << 16)]
    got = one(spark, [("last", " ".join(names)), ("w1", " ".join(names))], "p string, r string", tx.wer(F.col("p"), F.col("r")))
    assert [r[0] for r in got] == [1.0, 65535 / 65536]
    k = F.col("id")
    some = spark.range(1, 200_000).union(spark.range(tx.CODES - 100_000, tx.CODES + 1))
    assert some.agg(F.countDistinct(tx._private(k)), F.max(F.length(tx._private(k)))).head() == (300_000, 1)


def test_whole_turns_are_compared(spark, tmp_path):
    import duckdb

    from folioscope.plans import queries as plans

    long = "word " * 300
    rows = [("c", 0, "user", long), ("c", 1, "user", long + "end"), ("c", 2, "user", long), ("c", 3, "user", long), ("d", 0, "user", "a 1"), ("d", 1, "user", "a 2")]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    flags = {(r.conv_id, r.turn): (r.exact, r.edit_distance) for r in plans.text_compare_flags(spark, str(tmp_path)).collect()}
    assert flags == {("c", 1): (False, 3), ("c", 2): (False, 3), ("c", 3): (True, 0), ("d", 1): (False, 1)}
    assert {(r.conv_id, r.turn): r.wer for r in plans.wer_neighbours(spark, str(tmp_path)).collect()}["c", 1] == round(1 / 300, 9)
    # The SQL without its cut at 400 characters.
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for name in ("cer_neighbours", "text_compare_flags"):
        whole = plans.SQL[name].replace("substr(text, 1, 400)", "text")
        assert sorted(map(tuple, plans.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(db.execute(whole).fetchall())


def test_suspicious_rate_against_a_plain_version(spark):
    odd = lambda c: c == "�" or (unicodedata.category(c)[0] == "C" and c not in "\t\n\r")
    rows = [("OK\x00�",), ("",), ("a‌b\tc\x0b",), ("‌four",), ("x",)]
    for t, rate, allowed in one(spark, rows, "t string", "t", tx.suspicious_rate(F.col("t")), tx.suspicious_rate(F.col("t"), "‌")):
        visible = [c for c in t if not c.isspace()]
        assert rate == pytest.approx(sum(map(odd, visible)) / max(1, len(visible)))
        assert allowed <= rate


def test_language_script_direction(spark):
    rows = [("متن abc",), ("متن",), ("abc",), ("12",)]
    got = one(spark, rows, "t string", tx.infer_language(F.col("t")), tx.infer_script(F.col("t")))
    assert got == [("fa+en", "Arabic+Latin"), ("fa", "Arabic"), ("en", "Latin"), ("und", "Unknown")]
    n = lambda p: F.sum(tx.count_matching(F.col("t"), p))
    assert spark.createDataFrame([("شماره Ref",), ("قرارداد",)], "t string").agg(tx.direction(n(tx.RIGHT_TO_LEFT), n(tx.LATIN_LETTERS))).head()[0] == "mixed"
    assert one(spark, [("abc",)], "t string", tx.script_consistent(F.col("t"), F.lit("fa"), F.lit("Unknown"))) == [(False,)]


def test_label_value(spark):
    rows = [("Total: 12 EUR ",), ("TOTAL - x",), ("total",)]
    assert [r[0] for r in one(spark, rows, "t string", tx.label_value("total", F.col("t")))] == [None, "x", None]
    assert re.search(r"total\s*[:：-]\s*(\S(?:.*\S)?)$", "Total: 12 EUR ", re.I) is None


def test_canonical_json(spark):
    import hashlib
    import json

    rows = [('a"b\\\n', 3), ("é", None)]
    got = spark.createDataFrame(rows, "s string, n int").select("s", "n", hashing.stable_hash({"z": (F.col("n"), "number"), "a": (F.col("s"), "string")}).alias("h")).collect()
    for r in got:
        text = json.dumps({"z": r.n, "a": r.s}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.h == hashlib.sha256(text.encode()).hexdigest()
