"""Fill-in-middle transformation by one counted-quantifier match per text.

`regexp_count` gives the number n of tokens, a hash of the id gives the cuts a <= b, and a pattern made for the
row captures prefix, middle and suffix in one match: two groups of a and b - a possessive units, then the rest.
Possessive quantifiers are walked in a loop and give nothing back, so a match takes time linear in the text and
no stack, however large a and b are. Everything is a column expression: one pass over the rows, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: The same tokens, possessive.
STRICT_UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
MARKS = ("<P>", "<S>", "<M>")


def draws(seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row, from the sha256 of `seed:doc_id`; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: str, form: str) -> Column:
    """The text rebuilt from output and form alone: in a form other than plain each mark stands once."""
    def between(first: str, second: str | None) -> Column:
        tail = F.substring_index(F.col(output), first, -1)
        return F.substring_index(tail, second, 1) if second else tail
    psm = F.concat(between("<P>", "<S>"), between("<M>", None), between("<S>", "<M>"))
    spm = F.concat(between("<P>", "<M>"), between("<M>", None), between("<S>", "<P>"))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, suffix_first: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, restored for every row.

    A text becomes `<P>prefix<S>suffix<M>middle` (psm) or, in `suffix_first` of 100 cases, `<S>suffix<P>prefix<M>middle`
    (spm), its parts cut between tokens. It stays plain where it is empty, contains a mark itself, or falls
    outside `percent` of 100. Null texts count as empty. Repeated ids are cut alike; other columns are not read.
    Lengths are code points and null where plain.
    """
    h = draws(seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select("doc_id", text.alias("text"), *[x.alias(f"h{i}") for i, x in enumerate(h, 1)]).withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= percent)
    for mark in MARKS:
        plain |= F.contains("text", F.lit(mark))
    cut = cut.withColumns({"a": F.least(first, second), "b": F.greatest(first, second),
                           "form": F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")})
    pattern = F.concat(F.lit(rf"\A({STRICT_UNIT}{{"), F.col("a"), F.lit(rf"}}+)({STRICT_UNIT}{{"), F.col("b") - F.col("a"), F.lit(r"}+)((?s:.*+))\z"))
    shape = F.when(F.col("form") == "psm", "<P>$1<S>$3<M>$2").otherwise("<S>$3<P>$1<M>$2")
    out = cut.select("doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, shape)).alias("output"))
    mark = {m: F.locate(m, F.col("output")).cast("long") for m in MARKS}
    psm = F.col("form") == "psm"
    prefix = F.when(psm, mark["<S>"] - 4).otherwise(mark["<M>"] - mark["<P>"] - 3)
    middle = F.length("output") - mark["<M>"] - 2
    return out.select("doc_id", "n", "form", F.when(F.col("form") != "plain", prefix).alias("prefix_chars"),
                      F.when(F.col("form") != "plain", middle).alias("middle_chars"), "output", restored("output", "form").alias("restored"))


SQL = """
WITH parts AS (SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
draws AS (SELECT doc_id, body, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]') AS units, len(units) AS n,
  [CAST('0x' || substr(hex, 8 * i + 1, 8) AS BIGINT) for i in range(0, 4)] AS h FROM parts),
cuts AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
       WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws),
texts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(body) AS restored_sha256 FROM texts"""
