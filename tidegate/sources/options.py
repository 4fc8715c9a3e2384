"""CSV options under one contract, shared by conversion and counting."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidegate.results import GateError

# Charsets Spark reads without spark.sql.legacy.javaCharsets.
NATIVE_CHARSETS = {"UTF-8", "ISO-8859-1", "US-ASCII"}
# What the contract says about options, and Spark's names of the options that never change.
NO_FLAG = "{} must be true or false"
NO_CHARSET = "encoding must name a charset this JVM supports that encodes ASCII as ASCII, such as UTF-8, GBK or ISO-8859-1"
NO_DELIMITER = "delimiter must be nonempty and must not contain quotes, newlines or NUL"
NO_ESCAPE = "escape must contain exactly one character"
STRICT = {"mode": "FAILFAST", "enforceSchema": "false", "unescapedQuoteHandling": "RAISE_ERROR"}


def boolean(value, key: str) -> bool:
    known = {"true": True, "false": False}.get(str(value).strip().lower())
    if known is None:
        raise GateError(NO_FLAG.format(key))
    return known


def charset(spark: SparkSession, name: str | None) -> str:
    """The canonical name of an ASCII-compatible charset; UTF-8 without a name."""
    if name is None:
        return "UTF-8"
    every = "".join(map(chr, range(128)))
    try:
        found = spark.sparkContext._jvm.java.nio.charset.Charset.forName(name.strip())
        plain = found.canEncode() and bytes(found.encode(every).array()[:128]) == every.encode()
    except Exception:  # unknown, ill-formed or blank
        plain = False
    if not plain:
        raise GateError(NO_CHARSET) from None
    return found.name()


def csv_options(
    spark: SparkSession, *, header=True, delimiter: str = ",", escape: str = '"', multi_line=True,
    infer_schema=False, encoding: str | None = None,
) -> dict[str, str]:
    refused = {NO_DELIMITER: not delimiter or any(sign in delimiter for sign in '"\0\r\n'), NO_ESCAPE: len(escape) != 1}
    for message, wrong in refused.items():
        if wrong:
            raise GateError(message)
    flags = {"header": header, "inferSchema": infer_schema, "multiLine": multi_line}
    options = {key: "true" if boolean(value, key) else "false" for key, value in flags.items()}
    return options | STRICT | {"encoding": charset(spark, encoding), "escape": escape, "delimiter": delimiter}


def clean_schema(schema: str | None) -> str | None:
    return schema.strip() or None if isinstance(schema, str) else schema


def allow_charset(spark: SparkSession, name: str) -> None:
    """Lets this session's readers decode any charset of the JVM when ``name`` needs it."""
    if name not in NATIVE_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
