"""Column functions over logged SQL text: a conservative triage by tokens, not a parser.

A text is cut from left to right into tokens, so that what begins first hides what it holds; the rules are functions over the array
of tokens. They refuse what they do not know: operators, functions, unclosed quotes, nested comments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Options that leave an EXPLAIN a read, and names that make a predicate depend on when it runs.
EXPLAIN_OPTIONS = ["FORMAT", "VERBOSE", "COSTS", "SETTINGS", "GENERIC_PLAN", "SUMMARY", "MEMORY", "BUFFERS"]
CLOCK_NAMES = [
    "now", "current_timestamp", "current_time", "current_date", "localtime", "localtimestamp", "statement_timestamp",
    "transaction_timestamp", "txid_current", "pg_current_xact_id", "pg_current_xact_id_if_assigned",
]
SPECIAL_FORMS = ["coalesce", "nullif", "greatest", "least"]
#: PostgreSQL's reserved words, which no function can be named by without quotes.
RESERVED = [
    "all", "analyse", "analyze", "and", "any", "array", "as", "asc", "asymmetric", "both", "case", "cast", "check", "collate", "column", "constraint", "create",
    "current_catalog", "current_date", "current_role", "current_time", "current_timestamp", "current_user", "default", "deferrable", "desc", "distinct", "do", "else",
    "end", "except", "false", "fetch", "for", "foreign", "from", "grant", "group", "having", "in", "initially", "intersect", "into", "lateral", "leading", "limit",
    "localtime", "localtimestamp", "not", "null", "offset", "on", "only", "or", "order", "placing", "primary", "references", "returning", "select", "session_user",
    "some", "symmetric", "system_user", "table", "then", "to", "trailing", "true", "union", "unique", "user", "using", "variadic", "when", "where", "window", "with",
]
#: Words that are not reserved but name types or forms, never functions, and take brackets.
FORMS = [
    "between", "bigint", "bit", "boolean", "char", "character", "dec", "decimal", "exists", "float", "int", "integer", "interval", "national", "nchar", "numeric",
    "precision", "real", "row", "smallint", "time", "timestamp", "values", "varchar",
]
#: Reserved words that are values in themselves, after which an expression goes on.
VALUE_WORDS = ["current_catalog", "current_date", "current_role", "current_time", "current_timestamp", "current_user", "default", "end", "false", "localtime", "localtimestamp", "null", "session_user", "system_user", "true", "user"]
#: PostgreSQL's own operators; others are backed by anybody's functions.
OPERATORS = [
    "+", "-", "*", "/", "%", "^", "|/", "||/", "@", "&", "|", "#", "~", "<<", ">>", "||", "=", "<>", "!=", "<", ">", "<=", ">=", "~*", "!~", "!~*", "~~", "~~*", "!~~",
    "!~~*", "->", "->>", "#>", "#>>", "@>", "<@", "?", "?|", "?&", "@?", "@@", "@@@", "#-", "&&", "<->", "&<", "&>", "-|-", "<<=", ">>=", "<<|", "|>>", "&<|", "|&>", "^@", "!!",
    "=>",
]
#: Words that stand before a bracket without calling anything, where one of these words comes before them.
AFTER_WORD = {"by": ["group", "order", "partition"], "materialized": ["as", "not"], "sets": ["grouping"], "cube": ["by"], "rollup": ["by"], "varying": ["character", "char", "nchar", "bit"], "similar": ["not"], "join": ["left", "right", "full", "inner", "outer", "cross", "natural"]}
#: Words that call nothing where a call or an expression has just ended: they go on with it.
AFTER_CALL, AFTER_VALUE = ["over", "filter"], ["like", "ilike", "join"]

TAG = r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*+"
WORD = r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_$\x{80}-\x{10FFFF}]*+"
NUMBER = r"(?:0[xXoObB][0-9A-Fa-f_]++|(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9]++)?)"
SIGNS = "-+*/<>=~!@#%^&|`?"
#: Every alternative takes a character at least, so the matches together are the whole text. What is not closed shows as a single sign.
LEXICON = "|".join(
    [
        r"\s++", r"--[^\r\n]*+", r"/\*[\s\S]*?\*/", r"/\*",
        r"[eE]'(?:[^'\\]++|\\[\s\S]|'')*+'", r"'[^']*+'", r'"[^"]*+(?:""[^"]*+)*+"', WORD,
        rf"\$({TAG})\$[\s\S]*?\$\1\$", r"\$\$[\s\S]*?\$\$", r"\$[0-9]++(?![A-Za-z0-9_$\x{80}-\x{10FFFF}])",
        rf"{NUMBER}(?![A-Za-z0-9_$\x{{80}}-\x{{10FFFF}}])", r"\.?[0-9][A-Za-z0-9_$\x{80}-\x{10FFFF}]*+",
        "::|:=|[:;,.()\\[\\]]", rf"(?:(?!--|/\*)[{SIGNS}]){{1,32}}+", r"[\s\S]",
    ]
)
#: Escapes that a text may hold: a pattern goes through them one inside the other.
MOST_ESCAPES = 1_000


def leading_word(sql: Column) -> Column:
    """The leading letters after white space and block comments, in capitals; null if there are none."""
    word = F.upper(F.regexp_extract(sql, r"^\s*(?:/\*[\s\S]*?\*/\s*)*([A-Za-z]+)", 1))
    return F.nullif(word, F.lit(""))


def intent(sql: Column) -> Column:
    """Struct of intent, ticket and actor from the first block comment that has one of them. A value runs to the next key or
    the end; blanks and trailing commas and semicolons go; a key's first non-empty value counts. Keys match inside words too."""
    keys = ["intent", "ticket", "actor"]
    bodies = F.regexp_extract_all(sql, F.lit(r"/\*([\s\S]*?)\*/"), F.lit(1))

    def value(body: Column, key: str) -> Column:
        # Cut before every key; a piece that begins with this key holds its value.
        pieces = F.split(body, r"(?i)(?=(?:intent|ticket|actor):)", -1)
        own = F.filter(pieces, lambda p: F.startswith(F.lower(p), F.lit(f"{key}:")))
        texts = F.transform(own, lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.substring(p, len(key) + 2, 1 << 30), r"^\s+|\s+$", ""), r"[,;]+$", "")))
        return F.get(F.filter(texts, lambda t: t != ""), F.lit(0))

    parsed = F.transform(bodies, lambda b: F.struct(*[value(b, k).alias(k) for k in keys]))
    return F.get(F.filter(parsed, lambda p: p["intent"].isNotNull() | p["ticket"].isNotNull() | p["actor"].isNotNull()), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_sign(token: Column, *texts: str) -> Column:
    return F.coalesce((token["kind"] == "sign") & token["text"].isin(*texts), F.lit(False))


def is_word(token: Column, *texts: str) -> Column:
    return F.coalesce((token["kind"] == "word") & token["text"].isin(*texts), F.lit(False))


def is_name(token: Column) -> Column:
    return F.coalesce(token["kind"].isin("word", "quoted"), F.lit(False))


def classified(t: Column) -> Column:
    """Kind and text of one token, mostly told by its first character: words in lower case, quoted names without their quotes."""
    first, longer = F.ascii(t), F.length(t) > 1
    inner = F.regexp_replace(F.substring(t, 2, 1 << 30), '"$', "")
    ascii_lower = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    closed = longer & (t != "/*") & (F.instr(F.substring(t, 3, 1 << 30), "/*") == 0)
    letter = (first >= 97) & (first <= 122) | (first >= 65) & (first <= 90) | (first == 95) | (first >= 128)
    kind = (
        F.when(letter, F.when(F.endswith(t, F.lit("'")), "literal").otherwise("word"))
        .when(t.isin("(", ")", "[", "]", ",", ";", ".", ":", "::", ":="), "sign")
        .when(first == 39, F.when(longer, "literal").otherwise("broken"))
        .when(first.between(48, 57) | (first == 46), F.when(t.rlike(f"^{NUMBER}$"), "number").otherwise("broken"))
        .when(first == 34, F.when(longer, "quoted").otherwise("broken"))
        .when(first == 36, F.when(~longer, "broken").when(t.rlike("^.[0-9]+$"), "parameter").otherwise("literal"))
        .when(F.startswith(t, F.lit("--")), "blank")
        .when(F.startswith(t, F.lit("/*")), F.when(closed, "blank").otherwise("broken"))
        .when(t.rlike(f"^[{SIGNS}]+$"), "operator")
        .otherwise("broken")
    )
    text = F.when(letter & ~F.endswith(t, F.lit("'")), ascii_lower).when((first == 34) & longer, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(t)
    return F.struct(kind.alias("kind"), text.alias("text"))


def calls_nothing(t: Column, before: Column, before_that: Column) -> Column:
    """Whether a name before a bracket is no call, given the two tokens before it. It depends on the place: ``over`` after a closing
    bracket goes on with an expression, at its beginning it is somebody's function."""
    ended = before["kind"].isin("literal", "number", "parameter", "quoted") | is_sign(before, ")", "]") | (before["kind"] == "word") & (~before["text"].isin(RESERVED) | before["text"].isin(VALUE_WORDS))
    out = is_word(t, *RESERVED, *FORMS)
    for word, others in AFTER_WORD.items():
        out = out | is_word(t, word) & is_word(before, *others)
    out = out | is_word(t, *AFTER_CALL) & is_sign(before, ")") | is_word(t, *AFTER_VALUE) & F.coalesce(ended, F.lit(False)) | is_word(t, "like", "ilike") & is_word(before, "not")
    out = out | is_word(t, "explain") & before.isNull()
    # An alias or a type: AS name (columns), WITH name (columns), ::name (size).
    return out | is_name(t) & (is_word(before, "as", "recursive") | is_word(before, "with") & before_that.isNull() | is_sign(before, "::"))


def tokens(sql: Column) -> Column:
    """The text's tokens from left to right, without blanks and comments: array of kind (word, quoted, literal, number, parameter,
    operator, sign, broken), text, and call: the name, with its qualification, where the token is the last part of a called name.

    A text with more than ``MOST_ESCAPES`` escapes is a single broken token."""
    text = F.coalesce(sql, F.lit(""))
    marks = F.length(F.regexp_replace(text, r"[^\\]", "")) + F.when(text.rlike("[eE]'"), F.regexp_count(text, F.lit("''"))).otherwise(F.lit(0)) + F.regexp_count(text, F.lit('""'))
    beyond = F.array(F.struct(F.lit("broken").alias("kind"), F.lit("").alias("text")))
    seen = F.filter(F.regexp_extract_all(text, F.lit(LEXICON), F.lit(0)), lambda t: ~((F.ascii(t) == 32) | (F.ascii(t) >= 9) & (F.ascii(t) <= 13)))  # without runs of blanks, half of what there is
    found = F.filter(F.transform(seen, classified), lambda t: t["kind"] != "blank")

    def with_calls(ts: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            at = lambda k: F.get(ts, i + k)
            bracket = is_name(t) & is_sign(at(1), "(")
            call = bracket & (is_sign(at(-1), ".") | ~calls_nothing(t, at(-1), at(-2)))
            name = t["text"]
            dotted = F.lit(True)
            for k in (1, 3, 5):  # catalog.schema.package.name
                dotted = dotted & is_sign(at(-k), ".") & is_name(at(-k - 1))
                name = F.when(dotted, F.concat(at(-k - 1)["text"], F.lit("."), name)).otherwise(name)
            return F.struct(t["kind"].alias("kind"), t["text"].alias("text"), F.when(call, name).alias("call"), is_sign(at(-1), ".").alias("qualified"))

        return F.transform(ts, one)

    return let(F.when(marks > MOST_ESCAPES, beyond).otherwise(found), with_calls)


def function_names(ts: Column) -> Column:
    """Distinct names that the tokens call, qualification kept."""
    return F.array_distinct(F.transform(F.filter(ts, lambda t: t["call"].isNotNull()), lambda t: t["call"]))


def calls_beyond(ts: Column, names: list[str]) -> Column:
    """Whether the tokens call a function that is none of ``names``; a qualified one is none of them."""
    known = F.lit([n for n in names]).cast("array<string>")
    return F.exists(ts, lambda t: t["call"].isNotNull() & (t["qualified"] | ~F.array_contains(known, t["call"])))


def volatility(ts: Column, steady: list[str]) -> Column:
    """What keeps the WHERE parts, each up to RETURNING, from being run twice; null if nothing does."""
    known = F.lit([*steady, *SPECIAL_FORMS]).cast("array<string>")
    no = F.lit(False)
    begin = F.struct(no.alias("inside"), no.alias("clock"), no.alias("unknown"))

    def step(s: Column, t: Column) -> Column:
        inside = F.when(is_word(t, "where"), F.lit(True)).when(is_word(t, "returning"), no).otherwise(s["inside"])
        unknown = t["call"].isNotNull() & (t["qualified"] | ~F.array_contains(known, t["call"])) | (t["kind"] == "operator") & ~known_operator(t["text"])
        return F.struct(inside.alias("inside"), (s["clock"] | inside & is_word(t, *CLOCK_NAMES)).alias("clock"), (s["unknown"] | inside & unknown).alias("unknown"))

    told = F.aggregate(ts, begin, step, lambda s: F.when(s["clock"], F.lit("clock_name")).when(s["unknown"], F.lit("volatile_or_unknown")))
    return F.when((F.size(ts) == 1) & (F.get(ts, F.lit(0))["kind"] == "broken"), "volatile_or_unknown").otherwise(told)


def known_operator(text: Column) -> Column:
    """One of PostgreSQL's operators, or one with signs after it, which the server takes off unless special characters come before."""
    plain = F.regexp_replace(text, "[-+]+$", "")
    return text.isin(OPERATORS) | ~text.rlike("[~!@#%^&|`?]") & (plain.isin(OPERATORS) | (plain == ""))


def hidden_write(ts: Column) -> Column:
    """Any word that writes rows or locks them, INTO, operators that are not PostgreSQL's own, types and typed literals with a schema."""

    def one(t: Column, i: Column) -> Column:
        at = lambda k: F.get(ts, i + k)
        writes = is_word(t, "insert", "update", "delete", "merge", "into") | is_word(t, "share") & locks
        custom = is_word(t, "operator") & is_sign(at(1), "(") | (t["kind"] == "operator") & ~known_operator(t["text"])
        typed = (is_sign(t, "::") | is_word(t, "as")) & is_name(at(1)) & is_sign(at(2), ".") | (t["kind"] == "literal") & is_name(at(-1)) & is_sign(at(-2), ".")
        # No value is called, has parts or stands beside a name with parts, so what looks so is not understood.
        odd = t["kind"].isin("literal", "number", "parameter") & (is_sign(at(1), "(", ".") | is_name(at(1)) & is_sign(at(2), ".", "(") & ~calls_nothing(at(1), t, at(-1)))
        return F.coalesce(writes | custom | typed | odd, F.lit(False))

    locks = F.exists(ts, lambda t: is_word(t, "for"))
    return F.exists(F.transform(ts, one), lambda x: x)


def statement_word(ts: Column, at: Column) -> Column:
    """The first word at or after a place, opening brackets left out."""
    first = F.get(F.filter(F.slice(ts, at + 1, F.lit(1 << 30)), lambda t: ~is_sign(t, "(")), F.lit(0))
    return F.when(first["kind"] == "word", first["text"])


READS = ["select", "with", "values", "table"]


def explain_is_read(ts: Column) -> Column:
    """P5: EXPLAIN of a query, without ANALYZE, its options all harmless."""
    second = F.get(ts, F.lit(1))
    ends = F.array_position(F.transform(ts, lambda t: F.when(is_sign(t, ")"), F.lit(")")).otherwise(F.lit(""))), ")").cast("int")  # from 1
    inside = F.slice(ts, F.lit(3), F.greatest(ends - 3, F.lit(0)))
    harmless = F.forall(F.transform(inside, lambda t, i: ~((i == 0) | is_sign(F.get(ts, i + 1), ",")) | is_word(t, *[o.lower() for o in EXPLAIN_OPTIONS])), lambda x: x)
    bracketed = is_sign(second, "(") & ~statement_word(ts, F.lit(1)).isin(READS)
    skip = F.when(is_word(second, "verbose"), F.lit(2)).otherwise(F.lit(1))
    return F.when(bracketed, (ends > 2) & harmless & F.coalesce(statement_word(ts, ends).isin(READS), F.lit(False))).otherwise(F.coalesce(statement_word(ts, skip).isin(READS), F.lit(False)))


def brackets_hold(ts: Column) -> Column:
    """Whether each bracket closes the one opened last."""

    def step(open_: Column, t: Column) -> Column:
        # A bracket that closes another kind, or none, leaves a mark that nothing takes away.
        closes = lambda one, other: F.when(F.endswith(open_, F.lit(one)), F.regexp_replace(open_, ".$", "")).otherwise(F.concat(open_, F.lit(other)))
        return F.when(is_sign(t, "(", "["), F.concat(open_, t["text"])).when(is_sign(t, ")"), closes("(", ")")).when(is_sign(t, "]"), closes("[", "]")).otherwise(open_)

    return F.aggregate(ts, F.lit(""), step) == ""


def read_verdict(sql: Column, ts: Column, allowed: list[str]) -> Column:
    """Struct of is_read and reason; what is not shown to be a read is none. ``ts`` are the text's tokens."""
    broken = F.exists(ts, lambda t: t["kind"] == "broken")
    statements = F.size(F.filter(F.transform(ts, lambda t, i: ~is_sign(t, ";") & ((i == 0) | is_sign(F.get(ts, i - 1), ";"))), lambda x: x))
    by_word = lambda word: (
        F.when(word == "explain", F.when(explain_is_read(ts), "read").otherwise("write_on_readonly"))
        .when(word.isin(READS), "read")
        .when(word.isNull(), "parse_failed")
        .otherwise("write_on_readonly")
    )
    one = F.when(hidden_write(ts) | calls_beyond(ts, allowed), "write_on_readonly").otherwise(let(statement_word(ts, F.lit(0)), by_word))
    of_number = let(statements, lambda n: F.when(n == 0, "empty_statement").when(n > 1, "stacked_statement").otherwise(one))
    reason = F.when(sql.isNull() | broken | ~brackets_hold(ts), "parse_failed").otherwise(of_number)
    return let(reason, lambda r: F.struct((r == "read").alias("is_read"), F.nullif(r, F.lit("read")).alias("reason")))


def plan_estimate(line: Column) -> Column:
    """Struct of total_cost and rows from a plan line; null if either is missing."""
    cost = F.regexp_extract(line, r"cost=[^\s)]*?\.\.([0-9.]+)", 1).try_cast("double")
    rows = F.regexp_extract(line, r"rows=([0-9]+)", 1).try_cast("bigint")
    return F.when(cost.isNotNull() & rows.isNotNull(), F.struct(cost.alias("total_cost"), rows.alias("rows")))
