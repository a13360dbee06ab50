"""Column functions: numbers, names, configuration text, hashed draws, vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def to_number(text: Column) -> Column:
    """Decimal or scientific text to double, anything else to null.

    The cast alone would also take type suffixes, hexadecimal numbers and names such as NaN.
    """
    t = F.trim(text)
    end = F.right(t, F.lit(1))
    plain = (end.between("0", "9") | (end == ".")) & ~F.contains(F.lower(t), F.lit("x"))
    return F.when(plain, t.try_cast("double"))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def parse_literal(text: Column) -> Column:
    """Text as the first fitting of integer, float, date, string, tagged with its kind."""
    t = F.trim(text)
    whole = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))
    number = to_number(t)
    day = F.when(t.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), t.try_cast("date"))
    kind = (
        F.when(whole.isNotNull(), "int")
        .when(number.isNotNull(), "float")
        .when(day.isNotNull(), "date")
        .otherwise("string")
    )
    # Dates compare with dates and numbers with numbers, so both share one ordered column.
    ordinal = F.coalesce(number, F.unix_date(day).cast("double"))
    return F.struct(kind.alias("kind"), ordinal.alias("num"), t.alias("text"))


def digit_count(n: Column) -> Column:
    return F.greatest(F.length(n.cast("string")), F.lit(1))


def query_id(name: Column, scale: Column) -> Column:
    """``sf{scale}_`` plus the query name without its benchmark and lake digits."""
    short = F.regexp_extract(name, r"^[a-z][\w-]*_\d+_(q\w+)$", 1)
    return F.concat(F.lit("sf"), scale, F.lit("_"), F.when(short != "", short).otherwise(name))


def plan_key_fix(key: Column) -> Column:
    """Plan keys in the spelling used by query names."""
    for old, new in (("query", "q"), ("aug", "_aug"), ("_a", "a"), ("_b", "b")):
        key = F.replace(key, F.lit(old), F.lit(new))
    return key


def table_initials(table: Column) -> Column:
    """Initials of the words of a table name; the word ``char`` keeps two letters."""
    words = F.split(table, "_")
    return F.array_join(F.transform(words, lambda w: F.when(w == "char", "ch").otherwise(F.left(w, F.lit(1)))), "")


def _numbers(items: Column) -> Column:
    return F.transform(items, to_number)


def _piped_half(half: Column) -> Column:
    values = _numbers(F.filter(F.split(half, ";"), lambda x: F.trim(x) != ""))
    return let(values, lambda v: F.when(F.exists(v, lambda x: x.isNull()), F.array(F.lit(0.0))).otherwise(v))


def config_halves(conf: Column) -> Column:
    """Configuration text to a struct of engine and lake knob vectors."""
    halves = F.split(conf, r"\|", 2)

    def knob(item: Column) -> Column:
        bare = F.rtrim(F.trim(item), F.lit(_LETTERS))
        value = F.substring(bare, F.instr(bare, "=") + 1, 1 << 30)
        return F.coalesce(to_number(value), F.lit(0.0))

    piped = F.contains(conf, F.lit("|"))
    engine = F.when(piped, _piped_half(halves[0])).otherwise(F.transform(F.split(conf, ";"), knob))
    lake = F.when(piped, _piped_half(F.get(halves, F.lit(1)))).otherwise(F.array(F.lit(0.0)))
    return F.struct(engine.alias("engine"), lake.alias("lake"))


def config_vector(conf: Column, engine_id: Column, lake_id: Column) -> Column:
    halves = config_halves(conf)
    ids = F.array(engine_id.cast("double"), lake_id.cast("double"))
    return F.concat(halves["engine"], halves["lake"], ids)


def pad(vector: Column, width: Column | int) -> Column:
    """Exactly ``width`` entries: cut on the right or filled with zeros."""
    width = F.lit(width) if isinstance(width, int) else width
    missing = F.greatest(width - F.size(vector), F.lit(0))
    return F.concat(F.slice(vector, F.lit(1), width), F.array_repeat(F.lit(0.0), missing))


def one_hot(index: Column, size: int | Column) -> Column:
    last = F.lit(size - 1) if isinstance(size, int) else size - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def hash52(*parts: Column) -> Column:
    """52 reproducible bits of the parts joined by ``:``."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """Reproducible draw from the open interval (0, 1)."""
    return (hash52(*parts) + 0.5) / F.lit(float(2**52))


def normal(*parts: Column) -> Column:
    """Reproducible standard normal draw."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(*parts, F.lit("r"))))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, F.lit("a")))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside array lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(array_sum(p), lambda s: F.transform(p, lambda x: x / s)))


def log_sum_exp(logits: Column) -> Column:
    return let(
        F.array_max(logits),
        lambda top: top + F.log(array_sum(F.transform(logits, lambda x: F.exp(x - top)))),
    )


def argmax(logits: Column) -> Column:
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def layer_norm(vector: Column, eps: float = 1e-5) -> Column:
    """Zero mean and unit population variance over the entries of one vector."""

    def scaled(centred: Column) -> Column:
        var = dot(centred, centred) / F.size(centred)
        return let(F.sqrt(var + F.lit(eps)), lambda sd: F.transform(centred, lambda x: x / sd))

    mean = array_sum(vector) / F.size(vector)
    return let(let(mean, lambda m: F.transform(vector, lambda x: x - m)), scaled)


def fixed_point(vector: Column, digits: int = 4) -> Column:
    """Vector as comma-joined integers in units of ``10**-digits``."""
    scaled = F.transform(vector, lambda x: F.round(x * float(10**digits)).cast("bigint").cast("string"))
    return F.array_join(scaled, ",")
