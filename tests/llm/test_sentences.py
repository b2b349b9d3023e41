import math
import time

import pytest
from pyspark.sql import functions as F

from riskloom.llm.sentences import _g2, blocks, candidates, language, sentence_ends

SENTENCES = [
    "The parser is slow.", "Dr. @ reviewed the queue and found it stale.", "Nothing else changed.", "We measured 4.5 ms per call, i.e. about 5 % more.", "The queue can go.",
    "The build ended on the host of Mrs. @.", "Wait... is the parser slow?", 'The log said "disk full. retry later" and then stopped.', "Tests cover it, e.g. src/a.py, in part.", "Why was it edited?",
    "The U.S. mirror lags by 10 commits.", "It hung for 4 s...", "J. R. @ asked for it.", "Module oha-port imports the cache.", "If it is slow, it must wait.", '@ wrote: "The cache is slow."',
]
BASE = [
    "The parser is slow. Dr. Alder reviewed the queue and found it stale. Nothing else changed.",
    'Wait... is the parser slow? The log said "disk full. retry later" and then stopped. J. R. Cole asked for it.',
]


CASES = {
    "abbreviations": [
        (BASE[0], "en", ["The parser is slow.", "Dr. Alder reviewed the queue and found it stale.", "Nothing else changed."]),
        ("We measured 4.5 ms, i.e. about 5 % more. The queue can go.", "en", ["We measured 4.5 ms, i.e. about 5 % more.", "The queue can go."]),
        ("Tests cover it, e.g. src/a.py, in part. The U.S. mirror lags.", "en", ["Tests cover it, e.g. src/a.py, in part.", "The U.S. mirror lags."]),
    ],
    "quotations": [
        ('The log said "disk full. retry later" and then stopped. Nothing else changed.', "en", ['The log said "disk full. retry later" and then stopped.', "Nothing else changed."]),
        ("评审人说：“任务队列不安全。”会话表没有改动。“这样安全吗？”审查员问道。（没有改动。）完", "en", ["评审人说：“任务队列不安全。”", "会话表没有改动。", "“这样安全吗？”审查员问道。", "（没有改动。）", "完"]),
        ("担当者は「遅い。直して」と書いた。「安全ですか？」と尋ねた。", "en", ["担当者は「遅い。直して」と書いた。", "「安全ですか？」と尋ねた。"]),
    ],
    "scripts": [
        ("ต้องย้อนการแก้ไขนี้ทันที คิวงานไม่มีการเปลี่ยนแปลง", "en", ["ต้องย้อนการแก้ไขนี้ทันที", "คิวงานไม่มีการเปลี่ยนแปลง"]),
        ("और कुछ नहीं बदला। क्या यह ठीक है?", "en", ["और कुछ नहीं बदला।", "क्या यह ठीक है?"]),
    ],
    "layout": [
        (
            "## No. 1: x. y\r\n\r\nThe parser is\r\nslow. The queue can go.\r\n\r\n- one. Two\r\n* three\r\n1. four\r\n\r\n```\na. B\n\nc\n```\n> Nothing else\n> changed. The cache can go.\n\nno end", "en",
            ["## No. 1: x. y", "The parser is\r\nslow.", "The queue can go.", "- one. Two", "* three", "1. four", "```\na. B\n\nc\n```", "> Nothing else\n> changed.", "The cache can go.", "no end"],
        ),
        ("``` open\nnever. closed\n", "en", ["``` open\nnever. closed"]),
    ],
    "degenerate": [("", "en", []), (" \n\t\r\n ", "en", []), (">\n>\n", "en", []), ("...", "en", ["..."])],
}
LONG = "word " * 20000 + "end."
COVERED = BASE + ["A “b. c” d. E (f. g) h! «i ?» j. K", "a. " * 3, LONG]


@pytest.fixture(scope="module")
def split(spark):
    """Units of every text of CASES and COVERED, learned from 400 texts and these themselves."""
    import random

    rng = random.Random(4)
    names = ["Alder", "Birch", "Cole", "Dunn", "Eck", "Fenn", "Gray", "Holt"]
    fresh = lambda s: s.replace("@", rng.choice(names))
    texts = [(" ".join(fresh(rng.choice(SENTENCES)) for _ in range(rng.randint(2, 6))), "en") for _ in range(400)]
    ours = [c[:2] for cases in CASES.values() for c in cases] + [(t, "en") for t in COVERED]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(ours + texts)], "doc_id long, text string, lang string")
    ends = {}
    for r in sentence_ends(df).collect():
        ends.setdefault(r.doc_id, []).append(r.end_char)
    out = {}
    for i, (text, _) in enumerate(ours):
        at = sorted(ends.get(i, []))
        out[text] = [text[a:b].strip() for a, b in zip([0, *at], at)]
    return out


@pytest.mark.parametrize("kind", CASES)
def test_cases(split, kind):
    for text, _, expected in CASES[kind]:
        assert split[text] == expected


def test_degenerate(spark, split):
    assert split[LONG][-1].endswith("end.") and len(split["a. " * 3]) >= 1
    df = spark.createDataFrame([(1, None, "en", "z"), (2, "", None, "z"), (3, "Hi there", "XX", "z"), (3, "Hi there", "XX", "z"), (4, "🧪👩‍💻 ok", None, None)], "doc_id long, text string, lang string, end_char string")
    assert sorted(tuple(r) for r in sentence_ends(df).collect()) == [(3, 8), (3, 8), (4, 7)]
    assert sentence_ends(df.limit(0)).count() == 0


def test_offsets_cover_the_text_in_order(split):
    for text in COVERED[:3]:
        assert "".join(split[text]).replace(" ", "") == text.replace(" ", "")


def test_time_is_linear_in_the_text():
    """Marks, quotation marks and brackets without end, in texts without spaces."""
    for unit in ("a.B", "abc!D", "(", "()", "“x.”", 'a" "', "[(", "é。」", "“"):
        began = time.time()
        candidates(unit * (200_000 // len(unit)))
        assert time.time() - began < 10, unit


def test_ratio_of_shares(spark):
    row = spark.createDataFrame([(10, 20, 10, 200), (0, 5, 3, 9), (4, 8, 4, 8), (1, 0, 2, 5)], "a long, b long, c long, d long")
    got = [r[0] for r in row.select(_g2(*map(F.col, "abcd"))).collect()]
    assert got[0] == pytest.approx(2 * sum(k * math.log(k / e) for k, e in [(10, 20 * 20 / 220), (10, 20 - 20 * 20 / 220), (10, 200 * 20 / 220), (190, 200 - 200 * 20 / 220)]))
    assert got[1] < 0 and got[2] == 0 and got[3] == 0


def test_parts():
    assert [b.text for b in blocks("a\nb\n\n// c\n// d")] == ["a b", "c d"] and language("x ist nicht", None) == "de" and language("це", "en") == "ru"
    assert candidates("no end") == [] and [c.end for c in candidates("A b. C")] == [4]
    assert [(c.end, c.sure, c.word[0], c.next[0]) for c in candidates("The end.Next word v1.Two")] == [(8, None, "end", "Next")]
