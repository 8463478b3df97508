"""The statement triage: hand-judged statements, what may be inserted without changing a refusal, and hostile texts."""

import random

from ledgerline.operators import logs
from ledgerline.queries import logs as queries

NAMES = "name string"


def judged(spark, texts, allowed=queries.ALLOWED):
    log = spark.createDataFrame(list(enumerate(texts)), "log_id int, sql_text string")
    got = {r["log_id"]: (r["is_read"], r["reason"]) for r in logs.with_read_verdict(log, spark.createDataFrame([(n,) for n in allowed], NAMES)).collect()}
    return [got[i] for i in range(len(texts))]


def volatile(spark, texts):
    log = spark.createDataFrame(list(enumerate(texts)), "log_id int, sql_text string")
    got = {r["log_id"]: r["volatility"] for r in logs.with_volatility(log, queries.catalog(spark)).collect()}
    return [got[i] for i in range(len(texts))]


def statements():
    return [s.replace("''", "'").replace("{id}", "7") for s in queries.STATEMENTS]


def test_hand_judged_statements(spark):
    assert len(queries.STATEMENTS) >= 150
    assert judged(spark, statements()) == [(read, why) for _, read, why in queries.EXPECTED]
    assert volatile(spark, statements()) == [queries.VOLATILITY.get(i) for i in range(len(queries.STATEMENTS))]


INSERTED = ["/* x */", "/**/", "-- x\n", "--\r", "--x\r\n", " ", "\n\t", "'lit'", "'it''s ( '", "$$ ) $$", "$q$ '' $q$", "$é$ /* $é$", "E'\\' --'", "/* ' */", "/* \" */", "--'\n", "1", "$1"]


def test_what_is_inserted_never_makes_a_refusal_a_read(spark):
    """Comments, blanks and literals between the words of a refused statement leave it refused; blanks and comments leave a read a read."""
    r = random.Random(7)
    refused, kept = [], []
    for text, (_, read, why) in zip(statements(), queries.EXPECTED, strict=True):
        if why in ("write_on_readonly", "stacked_statement"):
            # A quote, comment or dollar sign may already be open where blanks are inside it: those statements are left as they are.
            if any(c in text for c in ("'", '"', "$", "--", "/*")):
                continue
            for _ in range(12):
                words = text.split(" ")
                for _ in range(r.randint(1, 3)):
                    words.insert(r.randrange(len(words) + 1), r.choice(INSERTED))
                refused.append(" ".join(words))
        elif read and not any(c in text for c in ("'", '"', "$", "--", "/*")):
            for _ in range(6):
                words = text.split(" ")
                words.insert(r.randrange(len(words) + 1), r.choice(["/* x */", "-- ' (\n", "--\r", "/* \" $$ */"]))
                kept.append(" ".join(words))
    assert len(refused) > 500 and len(kept) > 100
    through = [t for t, v in zip(refused, judged(spark, refused), strict=True) if v[0]]
    assert through == [], through
    assert [t for t, v in zip(kept, judged(spark, kept)) if not v[0]] == []


def test_calls_stay_calls_wherever_they_stand(spark):
    """A function that is not allowed is found in every place that a value may stand."""
    frames = [
        "SELECT {}", "SELECT a, {}", "SELECT ({})", "SELECT a FROM t WHERE {} > 1", "SELECT a FROM t WHERE b = 1 AND NOT {}", "SELECT a FROM t GROUP BY {}", "SELECT a FROM t ORDER BY b, {}",
        "SELECT a FROM t HAVING {}", "SELECT CASE WHEN {} THEN 1 END", "SELECT CASE a WHEN 1 THEN {} ELSE 2 END", "SELECT lower({})", "SELECT count(*) FILTER (WHERE {}) FROM t", "SELECT sum(a) OVER (ORDER BY {})",
        "WITH d AS (SELECT {}) SELECT * FROM d", "SELECT * FROM {}", "SELECT * FROM t, {} u", "SELECT * FROM t JOIN {} u ON true", "SELECT * FROM t JOIN u ON {}", "SELECT ARRAY[{}]", "SELECT a[{}]", "VALUES ({})",
        "SELECT a LIMIT {}", "SELECT -{}", "SELECT a || {}", "SELECT a BETWEEN {} AND 2", "SELECT a IN ({}, 2)", "SELECT a LIKE {}", "SELECT {}::int", "EXPLAIN SELECT {}", "SELECT DISTINCT {}", "SELECT 1 UNION SELECT {}",
    ]
    names = ["f(1)", "F (1)", "f/*x*/(1)", "s.f(1)", '"f"(1)', 's . "F" (1)', "filter(1)", "by(1)", "rows(1)", "set(1)", "explain(1)", "é(1)", "\u212aount(1)", "lower.x(1)"]
    texts = [f.format(n) for f in frames for n in names]
    assert [t for t, v in zip(texts, judged(spark, texts)) if v[0]] == []
    assert all(v[0] for v in judged(spark, [f.format("lower(b)") for f in frames]))


def test_long_and_hostile_texts(spark):
    many = "SELECT a FROM t WHERE id IN (" + ", ".join(map(str, range(5_000))) + ")"
    texts = [
        many, "SELECT '" + "x" * 1_000_000 + "'", "SELECT '" + "''" * 100_000 + "'", "/*" + "*" * 100_000 + "*/ SELECT 1", "SELECT E'" + "\\'" * 100_000, "SELECT \"" + '""' * 100_000 + '"(1)',
        "SELECT " + "(" * 3_000 + "1" + ")" * 3_000, "SELECT " + "+" * 100_000 + "1", "SELECT E'" + "\\\\" * 400 + "'", "SELECT \"" + '""' * 400 + '"', "$" * 50_000, "SELECT /*" * 5_000,
    ]
    read = [v[0] for v in judged(spark, texts)]
    assert read == [True, True, True, True, False, False, True, True, True, True, False, False]
    assert volatile(spark, ["DELETE FROM t WHERE a = E'" + "\\'" * 2_000]) == ["volatile_or_unknown"]
