"""Nested dictionaries, configuration, logs and prompts as map and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def infer_type(text: Column) -> Column:
    """(kind, value): integer, then float, else string."""
    whole, real = F.expr("null"), F.expr("null")
    plain = text.rlike(r"^\s*[+-]?[0-9]+\s*$")
    whole = F.when(plain, text.try_cast("bigint"))
    real = text.try_cast("double")
    kind = F.when(whole.isNotNull(), "int").when(real.isNotNull(), "float").otherwise("str")
    return F.struct(kind.alias("kind"), F.coalesce(whole.cast("string"), real.cast("string"), text).alias("value"))


def split_args(args: Column) -> Column:
    """``__a__b`` with ``1;2`` adds a=1 and b=2 to the map; the combined key stays."""
    parts = F.filter(F.map_entries(args), lambda e: e["key"].startswith("__"))
    pairs = lambda e: F.arrays_zip(F.filter(F.split(e["key"], "__"), lambda k: k != "").alias("key"), F.split(e["value"], ";").alias("value"))
    added = F.flatten(F.transform(parts, lambda e: F.transform(pairs(e), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))))
    return F.map_concat(args, F.map_from_entries(added))


def overlay(left: Column, right: Column) -> Column:
    """Right wins."""
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def strict_merge(left: Column, right: Column) -> Column:
    """Union of maps; a key on both sides is an error."""
    both = F.arrays_overlap(F.map_keys(left), F.map_keys(right))
    return F.when(both, F.raise_error(F.lit("duplicate key"))).otherwise(F.map_concat(left, right))


def reduce_maps(df: DataFrame, column: str, f) -> DataFrame:
    """Aggregate the values of each key over all rows; a row without the key does not count."""
    return df.select(F.explode(column).alias("key", "value")).groupBy("key").agg(f("value").alias("value"))


def flatten_dict(d: dict, sep: str = ".", prefix: str = "") -> dict:
    out: dict = {}
    for k, v in d.items():
        name = f"{prefix}{sep}{k}" if prefix else str(k)
        if isinstance(v, dict):
            out |= flatten_dict(v, sep, name)
        else:
            out[name] = v
    return out


def inherit(config: dict, section: str, base: dict) -> dict:
    """Fill what a section lacks from the base, right side first."""
    return {**config, section: {**base, **config.get(section, {})}}


def running_mean(df: DataFrame, key: list[str], order: list[str], value: str) -> Column:
    return F.avg(value).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def ema(df: DataFrame, key: str, order: list[str], value: str, rate: float) -> DataFrame:
    """Final e = rate e + (1 - rate) p over each key's ordered values, starting at the first."""
    seq = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    folded = df.groupBy(key).agg(seq.alias("s"))
    fold = F.aggregate(F.expr("slice(s, 2, size(s))"), F.col("s")[0]["__v"], lambda e, p: rate * e + (1 - rate) * p["__v"])
    return folded.select(key, fold.alias("ema"))


def log_means(df: DataFrame, step: str, value: str, every: int) -> DataFrame:
    """Mean of each run of ``every`` steps (from step 1); nulls do not count."""
    return df.groupBy(F.expr(f"({step} - 1) div {every}").alias("bucket")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def chat_prompt(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One prompt per conversation of user and assistant turns that the user opens; others are ``rejected``."""
    item = F.struct("turn", "role", "text")
    folded = messages.groupBy(conv).agg(F.array_sort(F.collect_list(item)).alias("m"))
    good = F.forall("m", lambda s: s["role"].isin("user", "assistant")) & (F.col("m")[0]["role"] == "user")
    # fixed values: the template's tags
    body = F.transform("m", lambda s: F.concat(F.when(s["role"] == "user", F.lit("<用户>")).otherwise(F.lit("<AI>")), s["text"]))
    return folded.select(conv, F.when(good, F.concat(F.array_join(body, ""), F.lit("<AI>"))).alias("prompt"), (~good).alias("rejected"))


def resource(spec: Column) -> Column:
    """scheme and rest of ``url::x``, ``local::x``; without a scheme it is local."""
    parts = F.split(spec, "::", 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("scheme"), parts[1].alias("path"))).otherwise(F.struct(F.lit("local").alias("scheme"), spec.alias("path")))


def nan_columns(names: list[str]) -> Column:
    """Names of the columns that hold NaN in this row."""
    return F.filter(F.array(*[F.when(F.isnan(n), F.lit(n)) for n in names]), lambda c: c.isNotNull())


# ---- configuration on the driver ----


class Settings(dict):
    """A dictionary whose keys are attributes too, inner dictionaries and those in lists included."""

    def __init__(self, *args, **kwargs):
        super().__init__()
        self.update(*args, **kwargs)

    @classmethod
    def _inner(cls, value):
        if isinstance(value, dict) and not isinstance(value, cls):
            return cls(value)
        return type(value)(cls._inner(v) for v in value) if isinstance(value, (list, tuple)) else value

    def __setitem__(self, key, value):
        super().__setitem__(key, self._inner(value))

    def update(self, *args, **kwargs):
        for key, value in dict(*args, **kwargs).items():
            self[key] = value

    def __getattr__(self, name):
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def __setattr__(self, name, value):
        self[name] = value


def typed(text):
    """A string as integer, else float, else itself; other values unchanged."""
    for kind in (int, float) if isinstance(text, str) else ():
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def listed(value, kind=int) -> list:
    """A list of ``kind``, also from text parted by commas."""
    out = [kind(v) for v in value.split(",")] if isinstance(value, str) else value
    if not isinstance(out, list) or not all(isinstance(v, kind) for v in out):
        raise TypeError(f"not a list of {kind.__name__}: {value!r}")
    return out


def command_line(args: list[str]) -> dict:
    """``--k=v`` or ``--k v`` pairs with typed values."""
    flat = [part for a in args for part in a.split("=", 1)]
    return {k.replace("--", ""): typed(v) for k, v in zip(flat[::2], flat[1::2], strict=False)}


def one_of(name: str, value, choices):
    """The value, an error if it is none of the choices."""
    if value not in choices:
        raise ValueError(f"{name} {value!r} is none of {list(choices)}")
    return value


def settle(layers: list[dict], overrides: dict, flags: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> Settings:
    """Configuration of layers, later ones first, and overrides above all; an override ``__a__b`` of ``1;2`` sets a and b too."""
    out: dict = {}
    for layer in (*layers, overrides):
        out |= layer
    for key, value in overrides.items():
        if key.startswith("__"):
            out |= dict(zip([k for k in key.split("__") if k], str(value).split(";"), strict=True))
    out = {k: typed(v) for k, v in out.items()}
    out |= {k: bool(out[k]) for k in flags if k in out}
    return Settings(out | {k: listed(out[k]) for k in lists if k in out})


def read_config(spark, folder: str, name: str, version: str | None = None, section: str = "train") -> dict:
    """``folder/config_<name>[_<version>].json`` by Spark's readers; the model part with the section's own and inherited keys."""
    import json

    path = f"{folder}/config_{name}{f'_{version}' if version else ''}.json"
    config = json.loads(spark.read.text(path, wholetext=True).first()[0])
    own = config.get(section, {})
    base = config.get(own["inherit"], {}) if "inherit" in own else {}
    return {**config.get("model", {}), **inherit(config, section, base)[section]}
