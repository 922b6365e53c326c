"""Secret scanning: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Only DataFrame functions touch rows. Patterns give base spans. Further tokens are judged by two character bigram models, one
trained on random strings (values that the patterns find, and generated ones), one on ordinary identifiers of a bounded sample of
documents; a token whose log-likelihood ratio is high enough becomes a span of kind `random`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Base kinds in order, their patterns, and the least length of the group that counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: What may be a random string: runs of these characters of at least LEAST.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
WORD = r"[A-Za-z0-9+/_-]{6,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: States of the chains: the start and each character.
STATES = len(ALPHABET) + 1
#: Inner columns.
TEXT, BASE, TOKENS, FOUND, NEW = (f"_docloom_{x}" for x in ("text", "base", "tokens", "found", "new"))
#: Documents whose tokens train the models, and nats per token and per character a span needs.
SAMPLE_DOCS, LEAST_RATIO, LEAST_RATE = 2000, 12.0, 0.5
#: Generated random strings of each form (hexadecimal, mixed, upper case and digits) that training always holds.
GENERATED = 400
#: Block of the two-level running sums below, and of texts that pieces are cut from.
RUN, BLOCK = 256, 4096


def spans(text: str, pattern: str, group: int, kind: int, least: int) -> Column:
    """array<struct<start,kind,end,value>> of the leftmost non-overlapping matches of a pattern, in code points, end exclusive.

    Offsets come from the lengths of matches and of what lies between them. Matches whose group is shorter than `least` are
    dropped after matching. value is the group.
    """
    regex = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = f"regexp_extract_all({text}, {regex}, 0)"
    value = f"regexp_extract_all({text}, {regex}, {group})" if group else "s.f"
    gaps = f"transform(split({text}, {regex}, -1), x -> char_length(x))"
    expr = f"""
      transform(array(named_struct('f', {found}, 'g', {gaps})), s ->
        transform(array(named_struct('f', s.f, 'v', {value},
            'n', transform(s.f, (x, i) -> s.g[i] + char_length(x)))), t ->
          transform(array({_prefix('t.n')}), e ->
            transform(t.f, (x, i) -> struct(e[i] - char_length(x) as start, {kind} as kind, e[i] as end, t.v[i] as value)))[0])[0])[0]
    """
    return F.expr(
        f"case when {text} rlike {regex} then filter({expr}, x -> char_length(x.value) >= {least}) "
        "else cast(array() as array<struct<start:int,kind:int,end:int,value:string>>) end"
    )


def _prefix(n: str, join: str = "{0} + {1}") -> str:
    """SQL: inclusive running sums of an int array (or what else joins two values of it, 0 being the least), in blocks of RUN."""
    scan = f"aggregate(x, cast(array() as array<int>), (s, v) -> concat(s, array({join.format('if(size(s) = 0, 0, s[size(s) - 1])', 'v')})))"
    blocks = f"transform(sequence(1, greatest(size({n}), 1), {RUN}), b -> slice({n}, b, {RUN}))"
    inner = f"transform({blocks}, x -> {scan})"
    total = "if(size(x) = 0, 0, x[size(x) - 1])"
    offsets = f"aggregate(p, array(0), (s, x) -> concat(s, array({join.format('s[size(s) - 1]', total)})))"
    return f"transform(array({inner}), p -> transform(array({offsets}), o -> flatten(transform(p, (x, i) -> transform(x, y -> {join.format('y', 'o[i]')}))))[0])[0]"


def base_spans(text: str) -> Column:
    """Base spans of all kinds, by start, then kind."""
    return F.array_sort(F.concat(spans(text, ASSIGN, 1, 0, 6), spans(text, ACCESS, 0, 1, 20), spans(text, HEX, 0, 2, 24)))


def _labelled(docs: DataFrame) -> DataFrame:
    """(label, token): 1 for values of base spans and generated strings, 0 for ordinary words of the sample, in three spellings."""
    ids = common.sample(docs.where("doc_id is not null").select("doc_id"), ["doc_id"], SAMPLE_DOCS).distinct()
    texts = docs.join(F.broadcast(ids), "doc_id").select(F.coalesce("text", F.lit("")).alias(TEXT))
    texts = texts.withColumn(BASE, base_spans(TEXT))
    good = texts.select(F.explode(f"{BASE}.value").alias("token")).select(F.lit(1).alias("label"), "token")
    plain = f"filter(regexp_extract_all({TEXT}, '{WORD}', 0), w -> not exists({BASE}, b -> contains(b.value, w) or contains(w, b.value)))"
    words = texts.select(F.explode(F.expr(plain)).alias("w"))
    bad = words.select(F.lit(0).alias("label"), F.explode(F.array("w", F.upper("w"), F.initcap("w"))).alias("token"))
    own = docs.sparkSession.range(GENERATED).select(
        F.lit(1).alias("label"),
        F.explode(
            F.array(
                F.substring(F.sha2(F.concat(F.lit("a"), "id").cast("binary"), 256), 1, 32),
                F.substring(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), "id").cast("binary"), 256))), 1, 32),
                F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("c"), "id").cast("binary"), 256))), "[^A-Za-z0-9]", ""), 1, 20)),
            )
        ).alias("token"),
    )
    return good.unionByName(bad).unionByName(own)


def _state(char: str) -> str:
    return f"instr('{ALPHABET}', {char})"


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios of the bigrams, STATES x STATES, row by row: the state before, then the character.

    Learned from the tokens of at most SAMPLE_DOCS documents picked by hash; transitions are smoothed by one count each.
    """
    pairs = (
        _labelled(docs)
        .select("label", F.expr(f"transform(split(token, ''), c -> {_state('c')})").alias("s"))
        .select("label", F.expr("filter(s, x -> x > 0)").alias("s"))
        .select("label", F.explode(F.expr(f"transform(s, (x, i) -> if(i = 0, 0, s[i - 1]) * {STATES} + x)")).alias("pair"))
        .groupBy("label", "pair")
        .count()
        .collect()
    )  # at most 2 x STATES x STATES rows
    count = [[0] * (STATES * STATES) for _ in range(2)]
    for label, pair, n in pairs:
        count[label][pair] += n
    if not sum(count[0]):  # nothing ordinary was seen: no token can be told from it
        return [0.0] * (STATES * STATES)
    out = [0.0] * (STATES * STATES)
    for a in range(STATES):
        total = [sum(count[k][a * STATES + 1 : (a + 1) * STATES]) for k in (0, 1)]
        for b in range(1, STATES):
            p = [(count[k][a * STATES + b] + 1) / (total[k] + STATES - 1) for k in (0, 1)]
            out[a * STATES + b] = math.log(p[1] / p[0])
    return out


def random_spans(tokens: str, base: str, model: list[float]) -> Column:
    """Spans of kind `random`: tokens that overlap no base span and whose ratio speaks for a random string."""
    table = "cast(split('" + ",".join(f"{v:.4f}" for v in model) + "', ',') as array<double>)"
    states = f"transform(split(x.value, ''), c -> {_state('c')})"
    ratio = f"aggregate(transform(array({states}), s -> transform(s, (v, i) -> {table}[if(i = 0, 0, s[i - 1]) * {STATES} + v]))[0], 0D, (a, v) -> a + v)"
    free = f"not exists({base}, b -> b.start < x.end and x.start < b.end)"
    return F.expr(f"filter({tokens}, x -> {free} and exists(array({ratio}), r -> r >= {LEAST_RATIO} and r >= {LEAST_RATE} * char_length(x.value)))")


def scan(docs: DataFrame, model: list[float] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, then base and found: arrays of (start, kind number, end, value) of base spans and of all spans.

    Null texts count as empty; without matches both arrays are empty. Every row keeps its row. Offsets are code points.
    """
    model = train(docs) if model is None else model
    rows = _with_base(docs.select(*keep, "text"))
    return rows.select(*keep, F.col(BASE).alias("base"), F.array_sort(F.concat(BASE, random_spans(TOKENS, BASE, model))).alias("found"))


def _with_base(docs: DataFrame) -> DataFrame:
    """docs with the text without null, its base spans and its tokens."""
    rows = docs.withColumn(TEXT, F.coalesce("text", F.lit("")))
    return rows.withColumn(BASE, base_spans(TEXT)).withColumn(TOKENS, spans(TEXT, TOKEN, 0, 3, 16))


def joined(spans_column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans_column}, x -> concat_ws(':', {kinds}[x.kind], x.start, x.end)), ',')")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, SHA-256 of the base spans, and all spans as text."""
    found = scan(docs)
    n = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", n(0), n(1), n(2), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span of the text replaced by a mark (overlapping spans by one) and n_chars counted anew; other rows unchanged.

    Null and empty texts have no spans. Each row is judged by its own text; repeated rows stay.
    """
    columns = docs.columns
    model = train(docs)
    rows = _with_base(docs)
    rows = rows.withColumn(FOUND, F.array_sort(F.concat(BASE, random_spans(TOKENS, BASE, model))))
    # a piece between two spans is cut from its blocks, so that the time follows the length of the text
    first, last = f"p.a div {BLOCK}", f"p.b div {BLOCK}"
    part = lambda k, cut: f"substring(coalesce(get(c, cast({k} as int)), ''), {cut})"
    piece = f"""if({first} = {last}, {part(first, f'p.a % {BLOCK} + 1, p.b - p.a')}, concat({part(first, f'p.a % {BLOCK} + 1')},
      array_join(slice(c, cast({first} as int) + 2, cast({last} - {first} - 1 as int)), ''), {part(last, f'1, p.b % {BLOCK}')}))"""
    ends = _prefix(f"{FOUND}.end", "greatest({0}, {1})")  # where what is spanned so far ends
    gap = f"struct(if(i = 0, 0, m[i - 1]) as a, if(i < size({FOUND}), {FOUND}[i].start, char_length({TEXT})) as b)"
    gaps = f"filter(transform(sequence(0, size({FOUND})), i -> {gap}), p -> p.a <= p.b)"
    cut = f"transform(array({ends}), m -> transform(array(regexp_extract_all({TEXT}, '(?s).{{1,{BLOCK}}}', 0)), c -> array_join(transform({gaps}, p -> {piece}), '{mark}'))[0])[0]"
    rows = rows.withColumn(NEW, F.when(F.size(FOUND) > 0, F.expr(cut)).otherwise(F.col("text")))
    out = []
    for c in columns:
        if c == "text":
            out.append(F.col(NEW).alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.size(FOUND) > 0, F.char_length(NEW).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return rows.select(*out)

