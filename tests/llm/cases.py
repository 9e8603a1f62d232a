"""Documents with the cases that every operator must bear."""

from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, grp string, host string, size long"

LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(60_000))

TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "The quick brown fox jumps over the lazy dog and runs on through the wood.",
    "The quick brown fox jumps over the lazy dog and runs on through the wood.",
    "the quick brown fox jumps over the lazy dog and runs on through the wood!",
    "a b c d e f a b c d e f a b c d e f\nsame line here\nsame line here\n\n",
    "É té à l'été, naïve   日本語 \x1c x\x85y 🙂🙂 ''s don't",
    "AB\x0bCD\x0cEF\rGH <|endoftext|> #$%&*|<>",
    "x" * 5000,
    LONG,
]


def rows():
    out = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), 5, "g", "h", 9) for i, t in enumerate(TEXTS)]
    return [*out, out[4], out[4], (None, "no id but some words here to count for the rules of quality now", None, None, None, 5, "g", "h", 9)]


def table(spark: SparkSession):
    return spark.createDataFrame(rows(), SCHEMA)


def stored(spark: SparkSession, folder, given=None) -> str:
    spark.createDataFrame(rows() if given is None else given, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)
