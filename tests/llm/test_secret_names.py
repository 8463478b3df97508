"""Secrets written directly after '=', in scans and redaction."""

from ledgerline.llm import secrets

from .test_llm import frame, rows

VALUE, UPPER = "wJ4lrXUt7nFEMIq2K9MDbPxR3fiCY5zQ8vLs", "4F9C2A7BE1D08365FA41"
CASES = [
    (f"AWS_SECRET_ACCESS_KEY={VALUE}", f"{VALUE}"),
    (f"export DB_PASS={VALUE} DEBUG=1", VALUE),
    (f"get /x?sig={VALUE}&page=2 now", VALUE),
    (f"sum={UPPER} end", UPPER),
    (f"KEY={VALUE}== end", f"{VALUE}=="),
    (f"a={UPPER};b={VALUE}", None),
]
PLAIN = [f"{VALUE[:19]}=x", "page=aaaaaaaaaaaaaaaaaaaaa1", "path=some_long_identifier_of_words_12", "x=1111111111111111111111"]


def test_values_after_equals(spark):
    df = frame(spark, [x for x, _ in CASES] + PLAIN)
    got = {r["doc_id"]: r for r in rows(secrets.scan(df))}
    clean = {r["doc_id"]: r["text"] for r in rows(secrets.redact(df))}
    for i, (x, value) in enumerate(CASES):
        if value:
            at = x.index(value)
            assert got[i]["spans"] == f"entropy:{at}:{at + len(value)}", x
            assert clean[i] == x.replace(value, "[SECRET]")
    assert clean[5] == "a=[SECRET];b=[SECRET]"
    for i, x in enumerate(PLAIN, len(CASES)):
        assert got[i]["spans"] == "" and clean[i] == x
