"""Packed fields against a scanner written character by character."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from histolith.operators.packed import split_packed

DELIMITERS = ";|,\t"


def scan(text):
    """Entries of a field, read one character at a time."""
    if text is None or not text.strip() or text.strip() == ".":
        return []
    out, i, n = [], 0, len(text)
    while i <= n:
        j = i
        while j < n and text[j].isspace() and text[j] not in DELIMITERS:
            j += 1
        k = j
        while j < n and not text[j].isspace() and text[j] != "=" and text[j] not in DELIMITERS:
            j += 1
        key, start = text[k:j], j
        while j < n and (text[j].isspace() or text[j] == "=") and text[j] not in DELIMITERS:
            j += 1
        value, quoted = "", False
        if j < n and j > start and text[j] in "\"'":
            mark, quoted = text[j], True
            j += 1
            while j < n:
                if mark == '"' and text[j : j + 2] == '\\"':
                    value += '"'
                    j += 2
                elif text[j] != mark:
                    value += text[j]
                    j += 1
                elif text[j : j + 2] == mark * 2:
                    value += mark
                    j += 2
                else:
                    j += 1
                    break
        b = j
        while j < n and text[j] not in DELIMITERS:
            j += 1
        value += text[b:j].rstrip()
        if quoted or text[i:j].strip():
            out.append((key, value))
        i = j + 1
    return out


def split(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, attribute string")
    got = {i: [] for i in range(len(texts))}
    for r in split_packed(df, "attribute", ["id"]).orderBy("id", "pos").collect():
        got[r.id].append((r.attr_key, r.attr_value))
        assert r.pos == len(got[r.id])
    return [got[i] for i in range(len(texts))]


CASES = [
    None,
    "",
    "   ",
    ".",
    " . ",
    ";;;",
    'a "x;y"; b z',
    "a='it''s'; note it's a 'soft' call",
    'a ""',
    'a """"',
    'a "unclosed; to the end',
    r'a "she said \"no\""; b 1',
    'a "x" tail ; b',
    "=v;= w;k==v",
    '"a" b;\'c\'',
    "a\tb\t\tc|d,e",
    "tag alt 5' end, b 'q'",
    "a 'x\"y'; b \"x'y\"",
    "k " + "v" * 5000 + ";" + 'q "' + "w;" * 3000 + '"',
]


def test_cases(spark):
    assert split(spark, CASES) == [scan(t) for t in CASES]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab =;|,\t\"'\\", max_size=14), min_size=60, max_size=120))
def test_random(spark, texts):
    assert split(spark, texts) == [scan(t) for t in texts]


def test_repeated_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a 1", "x"), (1, "a 1", "y")], "id int, attribute string, pos string")
    assert split_packed(df, "attribute", ["id"]).count() == 2
    assert split_packed(df.limit(0), "attribute", ["id"]).count() == 0
