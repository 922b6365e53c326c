"""Configuration and evaluation cases: YAML with variables, JSON cases."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Parts of keys whose values are not shown.
SECRET_KEYS = ("password", "secret", "token", "api_key", "access_key")
HIDDEN = "******"
_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def interpolate(text: str, env: Mapping[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default} replaced by the variable, its default, or nothing; an empty variable counts as unset."""
    env = os.environ if env is None else env
    return _VARIABLE.sub(lambda m: env.get(m[1]) or m[2] or "", text)


def interpolated(text, env: Column) -> Column:
    """`interpolate` over a text column with a map column of variables."""
    c, pattern = T._col(text), r"\$\{(\w+)(?::-([^}]*))?\}"
    found = lambda group: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    values = F.zip_with(found(1), found(2), lambda name, default: F.coalesce(F.nullif(env[name], F.lit("")), default, F.lit("")))
    return F.array_join(F.zip_with(F.split(c, pattern, -1), F.array_append(values, F.lit("")), lambda a, b: F.concat(a, b)), "")


def load(path: str, env: Mapping[str, str] | None = None, renamed: Mapping[str, str] | None = None) -> dict:
    """A YAML file's tree with variables replaced; renamed: old top-level keys to the new ones, which win where both stand."""
    import yaml

    with open(path, encoding="utf-8") as f:
        tree = yaml.safe_load(interpolate(f.read(), env)) or {}
    for old, new in (renamed or {}).items():
        if old in tree:
            value = tree.pop(old)
            tree.setdefault(new, value)
    return tree


class Watched:
    """A file's value, loaded anew when the file has changed; an unreadable change keeps the value."""

    def __init__(self, path: str, load=load):
        self._path, self._load, self._time, self._value = path, load, -1.0, None

    def get(self):
        try:
            time = os.stat(self._path).st_mtime_ns
            if time != self._time:
                self._value, self._time = self._load(self._path), time
        except (OSError, ValueError) as e:
            if self._value is None:
                raise e
        return self._value


def redacted(tree):
    """A configuration tree with the values of secret keys hidden."""
    if isinstance(tree, dict):
        return {k: HIDDEN if any(s in str(k).lower() for s in SECRET_KEYS) else redacted(v) for k, v in tree.items()}
    return [redacted(v) for v in tree] if isinstance(tree, list) else tree


def redacted_map(c) -> Column:
    """The same for a map column of settings."""
    secret = lambda k: F.lower(k).rlike("|".join(SECRET_KEYS))
    return F.transform_values(T._col(c), lambda k, v: F.when(secret(k), F.lit(HIDDEN)).otherwise(v))


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """(question, relevant, keywords) of evaluation files: JSON arrays of objects, or an object per line."""
    schema = "question string, relevant array<string>, keywords array<string>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).where("question is not null")
