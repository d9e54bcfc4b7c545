import random
import re

import pytest
from pyspark.sql import functions as F

from logtide.functions import masking, text as tx, tokens as tk

TAG_CASES = [
    ("<SCRIPT>x()</Script> tail", "x() tail"),
    ("one<br >  <br/>two", "one<br>two"),
    ("<td colspan=2>7</td>", "&lt;td colspan=2&gt;7&lt;/td&gt;"),
    ("p < q && r", "p &lt; q &amp;&amp; r"),
    ("kept </br> as is", "kept </br> as is"),
    ("open <b", "open &lt;b"),
    ("plain é text", "plain é text"),
    ("<i><u>k</u></i>", "&lt;i&gt;&lt;u&gt;k&lt;/u&gt;&lt;/i&gt;"),
    ("", ""),
]


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.o for r in df.select("i", expression(F.col("t")).alias("o")).orderBy("i").collect()]


def test_escape_tags(spark):
    assert column(spark, [c[0] for c in TAG_CASES], tx.escape_tags) == [c[1] for c in TAG_CASES]


def test_clean_for_classifier(spark):
    cases = {
        "GET http://a.b/c?d=1 from 10.0.0.1": "get url from ipaddress",
        "fooBarHTTPServer42x": "foo bar http serverx",
        "HTTPServer error_code=0x1F": "http server error code x f",
        "www.x.y  a\tb": "url a b",
        "": "",
    }
    assert column(spark, list(cases), tx.clean_for_classifier) == list(cases.values())


def test_counts_and_display(spark):
    assert column(spark, ["a  b1", ""], tx.token_count) == [3, 1]
    assert column(spark, ["a1b22", ""], tx.digit_count) == [3, 0]
    sizes = column(spark, ["-1", "999", "4000000", "2500000000"], lambda t: tx.size_display(t.cast("double")))
    assert sizes == [None, "999 B", "4.0 MB", "2.5 GB"]
    assert column(spark, ["/var/log/a.log", "b"], tx.base_name) == ["a.log", "b"]
    assert column(spark, ["x" * 499, "x" * 500], tx.preview) == ["x" * 499, "x" * 400 + "..."]


PLAIN_MASKS = [
    (r"\b(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))\b", "ID"),
    (r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", "IP"),
    (r"\b([0-9a-f]{6,} ?){3,}\b", "SEQ"),
    (r"\b([0-9A-F]{4} ?){4,}\b", "SEQ"),
    (r"\b(0x[a-f0-9A-F]+)\b", "HEX"),
    (r"\b([\-\+]?\d+)\b", "NUM"),
    (r'(?<=executed cmd )(".+?")', "CMD"),
]


def test_masks_equal_plain_regexes(spark):
    rng = random.Random(7)
    lines = ['executed cmd "ls -l" and "x"', "a1:b2:c3:d4:zz", "10.1.2.3 port -22"]
    for _ in range(4000):
        line = ""
        for _ in range(rng.randint(1, 8)):
            chars = rng.choice(["ab12", "AB12", "abcdef0123", "AG1", "xz", "1", "0x1F", ":"])
            size = rng.choice([1, 2, 3, 4, 4, 6, 6, 7, 8, 12, 13, 16, 18, 24])
            line += "".join(rng.choice(chars) for _ in range(size)) + rng.choice([" ", " ", "  ", ":", "-", "."])
        lines.append(line[:90])

    def plain(line):
        for pattern, name in PLAIN_MASKS:
            line = re.sub(pattern, f"<:{name}:>", line, flags=re.ASCII)
        return line

    assert column(spark, lines, masking.mask_variables) == [plain(x) for x in lines]


def test_masks_are_linear(spark):
    hostile = ["f" * 5000 + "g", "ABCD" * 20000, "ab:" * 20000, "abcdef " * 20000 + "zz"]
    out = column(spark, hostile, masking.mask_variables)
    assert out[0] == hostile[0] and out[1] == "<:SEQ:>" and out[3] == "<:SEQ:>zz"


def test_extract_variables(spark):
    df = spark.createDataFrame([
        (1, "a b_c d e", "a <*> c <*>"), (2, "a b", "a b"), (3, "", "x"), (4, "a b c", "<*> b"), (5, "a", "a <*> <*>"),
    ], "i int, t string, p string")
    out = df.select("i", masking.extract_variables(F.col("t"), F.col("p")).alias("v"), masking.var_count(F.col("p")).alias("n"))
    assert {r.i: (r.v, r.n) for r in out.collect()} == {
        1: (["b", "d e"], 2), 2: ([], 0), 3: ([], 0), 4: (["a"], 1), 5: ([], 2)
    }


def test_bracket_tokens(spark):
    cases = {
        "[sssd] krb5kdc[21363]: [2024-01-01 10:00] [12] [x] [Auth] KRB5kdc[1]": ["sssd", "auth", "krb5kdc"],
        "[a b][a b] plain": ["a b", "a b"],
        "nothing": [],
    }
    assert column(spark, list(cases), tk.bracket_tokens) == list(cases.values())


def test_match_tag(spark):
    tags = [
        {"name": "Error", "keywords": ["error", "err"], "patterns": [r"\[error\]", "FATAL"]},
        {"name": "Auth", "keywords": ["auth", "session"], "patterns": ["(", r"session\s+opened"]},
    ]

    def tag(t):
        return tk.match_tag(tk.bracket_tokens(t), t, tags, "Other")

    cases = {
        "[error] fatal": "Error",  # one token, one for all patterns
        "[auth] [pam_session] [error]": "Error",  # two each, the first wins
        "[auth] [session-err] x": "Auth",
        "Session   OPENED": "Auth",
        "quiet": "Other",
    }
    assert column(spark, list(cases), tag) == list(cases.values())
    assert column(spark, ["x"], lambda t: tk.match_tag(F.array(t), t, [], "Other")) == ["Other"]
