import random

import pytest
from pyspark.sql import functions as F

from songloom.functions import tokens
from songloom.operators import lexicon as lx

THAI = ("เธอ คือ ของขวัญ ฉัน รัก และ คิดถึง ทุกวัน ไม่ เคย ลืม หัวใจ ของ เรา อยู่ ด้วยกัน ตลอดไป ดวงดาว บน ท้องฟ้า ส่อง แสง "
        "ให้ ความรัก เดิน ทาง ไกล กลับ มา หา บ้าน เพลง นี้ ร้อง เพื่อ คน ดี ที่ สุด ใน โลก ฝน ตก ลม พัด ดอกไม้ บาน เช้า เย็น "
        "กลางคืน น้ำตา ไหล รอยยิ้ม หวาน มือ จับ กัน แน่น สัญญา ว่า จะ ไม่ทิ้ง").split()
LAO = "ຂ້ອຍ ຮັກ ເຈົ້າ ຫຼາຍ ບ້ານ ເຮົາ ມື້ນີ້ ຝົນ ຕົກ ດອກໄມ້ ງາມ ໄປ ມາ ກັບ ຄືນ ຫົວໃຈ".split()
KHMER = "ខ្ញុំ ស្រឡាញ់ អ្នក ផ្ទះ យើង ថ្ងៃនេះ ភ្លៀង ធ្លាក់ ផ្កា ស្អាត ទៅ មក វិញ បេះដូង ចម្រៀង".split()
BURMESE = "ကျွန်တော် ချစ် တယ် အိမ် မိုး ရွာ ပန်း လှ သွား ပြန် လာ နှလုံးသား သီချင်း နေ့ ညနေ".split()


def sentences(vocabulary, n, seed):
    rng = random.Random(seed)
    weights = [1 / (i + 3) for i in range(len(vocabulary))]
    return [rng.choices(vocabulary, weights, k=rng.randint(3, 9)) for _ in range(n)]


def borders(listed):
    out, at = set(), 0
    for w in listed[:-1]:
        at += len(w)
        out.add(at)
    return out


@pytest.fixture(scope="module")
def learnt(spark):
    lines = [("".join(s),) for v in (THAI, LAO, KHMER, BURMESE) for s in sentences(v, 1500, 1)]
    lines += [(None,), ("",), ("plain words only",), ("เพลง song เพลง",)]
    return lx.learn_lexicon(spark.createDataFrame(lines, "line string"), "line")


@pytest.mark.parametrize("vocabulary", [THAI, LAO, KHMER, BURMESE])
def test_words_of_unseen_lines(spark, learnt, vocabulary):
    held_out = sentences(vocabulary, 300, 2)
    lines = spark.createDataFrame([(i, "".join(s)) for i, s in enumerate(held_out)], "id int, line string")
    got = {r["id"]: r["tokens"] for r in lx.segment_lines(lines, "line", learnt).collect()}
    right = found = true = 0
    for i, s in enumerate(held_out):
        assert "".join(t["text"] for t in got[i]) == "".join(s) and all(t["isWord"] for t in got[i])
        a, b = borders([t["text"] for t in got[i]]), borders(s)
        right, found, true = right + len(a & b), found + len(a), true + len(b)
    assert right / found > 0.9 and right / true > 0.9


def test_known_phrase(spark, learnt):
    lines = spark.createDataFrame([("เธอคือของขวัญ",)], "line string")
    got = lx.segment_lines(lines, "line", learnt).first()["tokens"]
    assert [t["text"] for t in got] == ["เธอ", "คือ", "ของขวัญ"]


def test_mixed_and_odd_lines(spark, learnt):
    odd = ["ฉันรัก you  และเธอ", "Hello, world!", "月亮", "", None, "   ", "ฉัน๕๐๐", "๏", "_words ฉัน"]
    lines = spark.createDataFrame(list(enumerate(odd)), "id int, line string").withColumn("tokens", F.lit(1))
    got = {r["id"]: r["tokens"] for r in lx.segment_lines(lines, "line", learnt).collect()}
    for i, line in enumerate(odd):
        assert "".join(t["text"] for t in got[i]) == (line or "")
    assert [(t["text"], t["isWord"]) for t in got[0]] == [
        ("ฉัน", True), ("รัก", True), (" ", False), ("you", True), ("  ", False), ("และ", True), ("เธอ", True)]
    assert [t["text"] for t in got[1]] == ["Hello,", " ", "world!"] and [t["text"] for t in got[2]] == ["月", "亮"]
    assert lx.learn_lexicon(lines.limit(0), "line") == {}
    bare = lx.segment_lines(lines.filter("id = 0"), "line", {}).first()["tokens"]
    assert "".join(t["text"] for t in bare) == odd[0]


def test_clusters_are_the_same_in_both_engines(spark):
    listed = ["".join(s) for v in (THAI, LAO, KHMER, BURMESE) for s in sentences(v, 20, 3)]
    df = spark.createDataFrame([(x,) for x in listed], "run string")
    for r in df.select("run", tokens.line_clusters("run").alias("c")).collect():
        assert tokens.CLUSTER.findall(r["run"]) == r["c"] and "".join(r["c"]) == r["run"]
