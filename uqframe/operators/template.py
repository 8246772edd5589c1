"""Template fill over text tables: tokens in double brackets, values, and what is left over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed formats of the template contract: a token, what looks like part of one, a key.
TOKEN = "⟦([A-Z0-9_]+)(?::[^⟦⟧]*)?⟧"
FRAGMENT = r"⟦\s*[A-Za-z0-9_]|[A-Za-z0-9_]\s*⟧"
KEY = "^[A-Z0-9_]+$"
ILLEGAL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\uFFFE\\uFFFF]"
#: Most values of one template, since they are part of every row's expression; more raise.
MOST_VALUES = 5_000


def tokens(text: Column) -> Column:
    """Keys of the tokens of a text, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def clean_value(value: Column) -> Column:
    """Line breaks and tabs with the space around them become one space; ends are stripped."""
    return F.regexp_replace(F.regexp_replace(value, r"\s*[\t\r\n\u0085\u2028\u2029]+\s*", " "), r"^\s+|\s+$", "")


def value_state(key: Column, value: Column) -> Column:
    """ok, or the first rule a value breaks."""
    v = clean_value(value)
    return (
        F.when(~key.rlike(KEY), "bad key")
        .when(value.isNull(), "not a string")
        .when(value.rlike(ILLEGAL), "illegal character")
        .when(v == "", "empty")
        .when(v.rlike("[⟦⟧]"), "bracket")
        .when(v.rlike(r"(?<![\w.])-(?=\d)"), "ascii minus")
        .otherwise("ok")
    )


def usable(values: DataFrame) -> DataFrame:
    """key and cleaned value of the values that may be filled in."""
    state = value_state(F.col("key"), F.col("value"))
    return values.where(state.isin("ok", "ascii minus")).select("key", clean_value(F.col("value")).alias("value"))


def fill(df: DataFrame, values: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``filled``: known tokens replaced by their values as they are, unknown ones kept.

    The text is cut at its tokens and each piece looked up in a map of the values, so the cost is one pass, however many
    values there are. The values are one literal map; more than MOST_VALUES raise.
    """
    listed = usable(values).groupBy("key").agg(F.max("value").alias("value")).limit(MOST_VALUES + 1)
    entries = F.map_from_entries(F.collect_list(F.struct("key", "value")))
    lookup = listed.agg(F.when(F.count(F.lit(1)) <= MOST_VALUES, entries).otherwise(F.raise_error(F.lit(f"more than {MOST_VALUES} values"))).alias("m")).scalar()
    pieces = F.split(F.col(text), f"(?={TOKEN.replace('(', '(?:', 1)})|(?<=⟧)")
    key = lambda p: F.regexp_extract(p, f"^{TOKEN}$", 1)
    put = lambda p: F.when(key(p) != "", F.coalesce(F.try_element_at(F.col("__m"), key(p)), p)).otherwise(p)
    return df.withColumn("__m", lookup).withColumn("filled", F.array_join(F.transform(pieces, put), "")).drop("__m")


def fill_segments(segments: DataFrame, values: DataFrame, paragraph: str = "para", segment: str = "seg", text: str = "text") -> DataFrame:
    """Paragraphs whose tokens may cross segments: segments are joined in order, then filled: paragraph, filled."""
    joined = segments.groupBy(paragraph).agg(F.sort_array(F.collect_list(F.struct(segment, text))).alias("s")).select(paragraph, F.array_join(F.transform("s", lambda x: x[text]), "").alias("text"))
    return fill(joined, values).select(paragraph, "filled")


def leftovers(text: Column) -> Column:
    """none, error for what looks like part of a token, or warning for a stray bracket."""
    rest = F.regexp_replace(text, TOKEN, "")
    return F.when(rest.rlike(FRAGMENT), "error").when(rest.rlike("[⟦⟧]"), "warning").otherwise("none")


def status(df: DataFrame, values: DataFrame, text: str = "text") -> DataFrame:
    """key, used, state: replaced, missing (a token without a value) or absent (a value without a token)."""
    used = df.select(F.explode(tokens(F.col(text))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("used"))
    known = usable(values).select("key").distinct().withColumn("known", F.lit(True))
    return used.join(known, "key", "full").select("key", F.coalesce("used", F.lit(0)).alias("used"), F.when(F.col("known").isNull(), "missing").when(F.col("used").isNull(), "absent").otherwise("replaced").alias("state"))


def report(df: DataFrame, values: DataFrame, contract: DataFrame, text: str = "text") -> DataFrame:
    """key, tokens and state of every key that texts, values or the contract (key) name.

    replaced; missing (tokens without a usable value); unused (a usable value without tokens); contract absent (a key of
    the contract without a value and without tokens). A value that isn't usable counts as none.
    """
    used = df.select(F.explode(tokens(F.col(text))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("tokens"))
    known = usable(values).select("key").distinct().withColumn("has_value", F.lit(True))
    asked = contract.select("key").distinct().withColumn("asked", F.lit(True))
    every = used.join(known, "key", "full").join(asked, "key", "full")
    has_tokens, has_value = F.col("tokens") > 0, F.col("has_value").isNotNull()
    state = F.when(has_tokens & has_value, "replaced").when(has_tokens, "missing").when(has_value, "unused").otherwise("contract absent")
    return every.na.fill(0, ["tokens"]).select("key", "tokens", state.alias("state"))


def exit_code(df: DataFrame, values: DataFrame, contract: DataFrame, text: str = "text", allow_missing: bool = False) -> DataFrame:
    """One row: replaced, missing, unused, contract_absent (keys of each state), fragments (texts with what looks like a
    broken token) and code: 0 if nothing is missing (or may be) and no text has fragments, else 1."""
    states = ("replaced", "missing", "unused", "contract absent")
    keys = report(df, values, contract, text).agg(*[F.count_if(F.col("state") == s).alias(s.replace(" ", "_")) for s in states])
    broken = df.agg(F.count_if(leftovers(F.coalesce(F.col(text), F.lit(""))) == "error").alias("fragments"))
    blocked = (F.col("fragments") > 0) if allow_missing else (F.col("fragments") > 0) | (F.col("missing") > 0)
    return keys.join(F.broadcast(broken)).withColumn("code", blocked.cast("int"))
