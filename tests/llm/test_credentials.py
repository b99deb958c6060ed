import re

from cases import DOCS, no_docs, odd_docs

from songloom.llm import credentials as c


def base(text):
    """The strong spans by the rule as worded: all matches, then the failing ones dropped."""
    found = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    for rank, pattern, passes in (
        (0, assign, lambda m: len(m[2]) >= 6),
        (1, re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (2, re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if passes(m)]
    return sorted(found)


KEY = "AKIA" + "Q7" * 8
TEXTS = [
    "password=abcdefg and token : 'abc' then PASSWD = hunter22", "AKIASHORT " + KEY + " x" + KEY + "Z",
    "é中 hex " + "0a" * 12 + " " + "0a" * 11, "secret=token=abc api_key=token:abcdefgh apikey=' abcdef",
    "ſecret=abcdefgh pasKword=abcdefgh", "token=ab token=abcdef " + "f" * 24, "",
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


def test_base_spans_as_worded(spark):
    got = {r["doc_id"]: r for r in c.scan(docs(spark, TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        want = base(text)
        assert [(s["start"], s["rank"], s["end"]) for s in got[i]["strong"]] == want
        assert [got[i][n] for n in ("n_assign", "n_access", "n_hex")] == [sum(k == rank for _, k, _ in want) for rank in range(3)]


def weak_kinds(spark, texts, reach=200):
    rows = c.scan(docs(spark, texts), reach).collect()
    return {r["doc_id"]: [c.KINDS[s["rank"]] for s in r["spans"] if s["rank"] > 2] for r in rows}


def test_weak_parts_count_only_with_a_complement_near(spark):
    random = "aB3dE5gH7jK9mN1pQ3sT5vX7"
    texts = [
        f"key {random} alone", f"user=maria and {random}", f"user=maria {'. ' * 300} {random}", "https://db.example.com/login alone",
        f"https://db.example.com/login with {random}", f"{KEY} at https://db.example.com", f"{random} {random}",
    ]
    got = weak_kinds(spark, texts)
    assert got == {
        0: [], 1: ["identifier", "secret"], 2: [], 3: [], 4: ["endpoint", "secret"], 5: ["endpoint"], 6: [],
    }


def test_prefixed_names_and_long_runs_are_parts(spark):
    random = "aB3dE5gH7jK9mN1pQ3sT5vX7"
    names = ["DB_USER=admin", "aws_access_key_id = abc12", "user_id=abc12", "spring.datasource.username: admin", "my-account=abc"]
    texts = [f"{name}\n{random}" for name in names] + [f"{h}=db.example.com:5432\n{random}" for h in ("DB_HOST", "mail.server")]
    texts += ["user=maria " + random * 40, f"aws_secret_access_key: {random}", "DB_USER=admin alone"]
    got = weak_kinds(spark, texts)
    assert got == {**{i: ["identifier", "secret"] for i in range(5)}, 5: ["endpoint", "secret"], 6: ["endpoint", "secret"],
                   7: ["identifier", "secret"], 8: [], 9: []}
    spans = c.weak_spans("user=maria " + random * 40, [])
    assert (11, 4, 11 + 24 * 40) in spans


def test_reach_is_exact_across_scopes(spark):
    random = "aB3dE5gH7jK9mN1pQ3sT5vX7"
    cases = [(pad, gap) for pad in range(0, 60, 7) for gap in (1, 19, 20, 21, 45)]
    texts = ["-" * pad + " user=maria" + " " * gap + random for pad, gap in cases]
    got = weak_kinds(spark, texts, 20)
    for i, (_, gap) in enumerate(cases):
        assert got[i] == (["identifier", "secret"] if gap <= 20 else [])


def test_odd_rows_and_empty_table(spark):
    assert c.scan(odd_docs(spark)).count() == 13
    assert c.scan(no_docs(spark)).collect() == []
    long = ("user=maria " + "x" * 40 + " ") * 2000 + "aB3dE5gH7jK9mN1pQ3sT5vX7"
    assert weak_kinds(spark, [long])[0].count("secret") == 1
