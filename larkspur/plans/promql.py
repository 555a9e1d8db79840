"""PromQL on DataFrames: every operator handles all steps of a range query at once.

Samples are (labels, ts ms, value); labels are a sorted array of (k, v) entries, which Spark can group and
join by. A vector is a frame (step, labels, value); a scalar is a number or a frame (step, value) with one
row per step (a range query has at most 50 000 steps).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from dataclasses import replace as dc_replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOOKBACK = 300_000
SUBQUERY_STEP = 60_000
MAX_STEPS = 50_000
INF, NAN = float("inf"), float("nan")


def entries(labels: dict[str, Column]) -> Column:
    """Label columns as sorted entries; empty and null labels are left out."""
    parts = [F.struct(F.lit(k).alias("k"), c.cast("string").alias("v")) for k, c in sorted(labels.items())]
    return F.filter(F.array(*parts), lambda e: e["v"].isNotNull() & (e["v"] != ""))


def samples(df: DataFrame, labels: Sequence[str], fields: Sequence[str], ts: str = "ts") -> DataFrame:
    """A wide time-series table as samples: each field is a metric of its name."""
    ms = F.col(ts).cast("long") if df.schema[ts].dataType.typeName() in ("long", "integer") else F.unix_millis(F.col(ts).cast("timestamp"))
    parts = []
    for f in fields:
        named = {"__name__": F.lit(f), **{x: F.col(x) for x in labels}}
        parts.append(df.where(F.col(f).isNotNull()).select(entries(named).alias("labels"), ms.alias("ts"), F.col(f).cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def label(name: str, labels: Column | str = "labels") -> Column:
    """A label's value, or ''."""
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(F.try_element_at(F.filter(c, lambda e: e["k"] == name), F.lit(1))["v"], F.lit(""))


def without(names: Sequence[str], labels: Column | str = "labels") -> Column:
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.filter(c, lambda e: ~e["k"].isin(*names)) if names else c


def only(names: Sequence[str], labels: Column | str = "labels") -> Column:
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.filter(c, lambda e: e["k"].isin(*names)) if names else F.filter(c, lambda e: F.lit(False))


def with_label(c: Column, name: str, value: Column) -> Column:
    one = F.array(F.struct(F.lit(name).alias("k"), value.alias("v")))
    return F.array_sort(F.when(value == "", without([name], c)).otherwise(F.concat(without([name], c), one)))


# --- syntax ------------------------------------------------------------------------------------------------

UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
_TOKEN = re.compile(
    r"""\s*(?:(?P<dur>(?:\d+(?:ms|[smhdwy]))+(?![\w.]))|(?P<num>0x[0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<id>[A-Za-z_][\w:.]*)
    |(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`)|(?P<op>=~|!~|==|!=|<=|>=|[-+*/%^()\[\]{},=<>@:]))""",
    re.X,
)
_BINARY = [["or"], ["and", "unless"], ["==", "!=", "<=", "<", ">=", ">"], ["+", "-"], ["*", "/", "%"]]
AGGREGATES = ("sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "quantile", "topk", "bottomk", "count_values")


@dataclass
class Number:
    value: float


@dataclass
class String:
    value: str


@dataclass
class Selector:
    matchers: list[tuple[str, str, str]]
    window: int | None = None
    offset: int = 0
    at: object = None


@dataclass
class Subquery:
    inner: object
    window: int
    step: int
    offset: int = 0
    at: object = None


@dataclass
class Call:
    name: str
    args: list


@dataclass
class Aggregate:
    name: str
    args: list
    by: bool = True
    labels: list[str] = field(default_factory=list)


@dataclass
class Binary:
    op: str
    left: object
    right: object
    bool_: bool = False
    on: list[str] | None = None
    ignoring: list[str] = field(default_factory=list)
    group: str | None = None
    graft: list[str] = field(default_factory=list)


@dataclass
class Negate:
    inner: object


def _duration(text: str) -> int:
    return sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)(ms|[smhdwy])", text))


class Parser:
    """Recursive descent with binding powers."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.pos = 0

    def parse(self):
        e = self.binary(0)
        if self.pos < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.pos][1]!r}")
        return e

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.pos + ahead][1] if self.pos + ahead < len(self.tokens) else None

    def kind(self) -> str | None:
        return self.tokens[self.pos][0] if self.pos < len(self.tokens) else None

    def next(self) -> str:
        if self.pos >= len(self.tokens):
            raise ValueError("unexpected end")
        self.pos += 1
        return self.tokens[self.pos - 1][1]

    def take(self, what: str) -> bool:
        if self.peek() == what and self.kind() != "str":
            self.pos += 1
            return True
        return False

    def need(self, what: str) -> None:
        if not self.take(what):
            raise ValueError(f"expected {what!r}, found {self.peek()!r}")

    def names(self) -> list[str]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.next())
            self.take(",")
        return out

    def binary(self, level: int):
        if level == len(_BINARY):
            return self.unary()
        left = self.binary(level + 1)
        while self.kind() in ("op", "id") and self.peek() in _BINARY[level]:
            node = Binary(self.next(), left, None)
            if self.take("bool"):
                node.bool_ = True
            if self.peek() in ("on", "ignoring"):
                if self.next() == "on":
                    node.on = self.names()
                else:
                    node.ignoring = self.names()
                if self.peek() in ("group_left", "group_right"):
                    node.group = self.next()
                    node.graft = self.names() if self.peek() == "(" else []
            node.right = self.binary(level + 1)
            left = node
        return left

    def unary(self):
        if self.take("-"):
            return Negate(self.unary())
        if self.take("+"):
            return self.unary()
        left = self.postfix()
        if self.take("^"):
            return Binary("^", left, self.unary())
        return left

    def postfix(self):
        e = self.primary()
        while True:
            if self.take("["):
                window = _duration(self.next())
                if self.take(":"):
                    step = SUBQUERY_STEP if self.peek() == "]" else _duration(self.next())
                    self.need("]")
                    e = Subquery(e, window, step)
                else:
                    self.need("]")
                    e = dc_replace(e, window=window)
            elif self.take("offset"):
                sign = -1 if self.take("-") else 1
                e = dc_replace(e, offset=sign * _duration(self.next()))
            elif self.take("@"):
                if self.peek() in ("start", "end"):
                    at = self.next()
                    self.need("(")
                    self.need(")")
                else:
                    at = int(float(self.next()) * 1000)
                e = dc_replace(e, at=at)
            else:
                return e

    def primary(self):
        kind, text = self.kind(), self.next()
        if kind == "num":
            return Number(float(int(text, 16)) if text.startswith("0x") else float(text))
        if kind == "dur":
            return Number(_duration(text) / 1000)
        if kind == "str":
            return String(_unquote(text))
        if text == "(":
            e = self.binary(0)
            self.need(")")
            return e
        if text == "{":
            self.pos -= 1
            return Selector(self.matchers())
        if kind != "id":
            raise ValueError(f"unexpected {text!r}")
        if text.lower() in ("inf", "nan") and self.peek() != "{":
            return Number(float(text))
        if text in AGGREGATES and self.peek() in ("(", "by", "without"):
            node = Aggregate(text, [])
            self.grouping(node)
            node.args = self.arguments()
            self.grouping(node)
            return node
        if self.peek() == "(":
            return Call(text, self.arguments())
        matchers = [("__name__", "=", text)]
        return Selector(matchers + (self.matchers() if self.peek() == "{" else []))

    def grouping(self, node: Aggregate) -> None:
        if self.peek() in ("by", "without"):
            node.by = self.next() == "by"
            node.labels = self.names()

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.binary(0))
            self.take(",")
        return out

    def matchers(self) -> list[tuple[str, str, str]]:
        self.need("{")
        out = []
        while not self.take("}"):
            name, op = self.next(), self.next()
            out.append((name, op, _unquote(self.next())))
            self.take(",")
        return out


def _unquote(text: str) -> str:
    body = text[1:-1]
    return body if text[0] == "`" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), body)


def parse(text: str):
    return Parser(text).parse()


# --- evaluation ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grid:
    start: int
    end: int
    step: int

    def __post_init__(self) -> None:
        if (self.end - self.start) // self.step + 1 > MAX_STEPS:
            raise ValueError(f"more than {MAX_STEPS} steps")

    def frame(self, spark: SparkSession) -> DataFrame:
        n = (self.end - self.start) // self.step + 1
        return spark.range(n).select((F.col("id") * self.step + self.start).alias("step"))


def ieee(op: str, a: Column, b: Column) -> Column:
    """Arithmetic that yields infinities and NaN where SQL would fail or give NULL."""
    if op in "+-*":
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    if op == "/":
        zero = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)
        return F.when(b == 0, zero).otherwise(F.try_divide(a, b))
    if op == "%":
        return F.when(b == 0, NAN).when(F.isnan(a) | F.isnan(b) | (F.abs(a) == INF), NAN).when(F.abs(b) == INF, a).otherwise(F.try_mod(a, b))
    return F.pow(a, b)


def comparison(op: str, a: Column, b: Column) -> Column:
    """NaN equals nothing and is not ordered."""
    odd = F.isnan(a) | F.isnan(b)
    test = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return F.when(odd, F.lit(op == "!=")).otherwise(test)


COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")


def _day(c: Column) -> Column:
    return F.date_from_unix_date(F.floor(c / 86400).cast("int"))


def _natural(c: Column) -> Column:
    return F.when(c > 0, F.log(c)).when(c == 0, -INF).otherwise(NAN)


MATH: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "ceil": lambda c: F.when(F.isnan(c) | (F.abs(c) == INF), c).otherwise(F.ceil(c).cast("double")),
    "floor": lambda c: F.when(F.isnan(c) | (F.abs(c) == INF), c).otherwise(F.floor(c).cast("double")),
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)).otherwise(NAN), "exp": F.exp, "ln": _natural,
    "log2": lambda c: _natural(c) / math.log(2), "log10": lambda c: F.when(c > 0, F.log10(c)).otherwise(_natural(c)),
    "sgn": lambda c: F.when(F.isnan(c), c).otherwise(F.signum(c)),
    "minute": lambda c: F.floor(F.pmod(c, F.lit(3600.0)) / 60).cast("double"), "hour": lambda c: F.floor(F.pmod(c, F.lit(86400.0)) / 3600).cast("double"),
    "day_of_week": lambda c: (F.dayofweek(_day(c)) - 1).cast("double"), "day_of_month": lambda c: F.dayofmonth(_day(c)).cast("double"),
    "day_of_year": lambda c: F.dayofyear(_day(c)).cast("double"), "days_in_month": lambda c: F.dayofmonth(F.last_day(_day(c))).cast("double"),
    "month": lambda c: F.month(_day(c)).cast("double"), "year": lambda c: F.year(_day(c)).cast("double"),
}
CALENDAR = ("minute", "hour", "day_of_week", "day_of_month", "day_of_year", "days_in_month", "month", "year")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once a row: an expression within a lambda is evaluated for each element."""
    return F.transform(F.array(x), f)[0]


def _quantile(values: Column, phi: float) -> Column:
    """Interpolated quantile of a sorted array."""
    if math.isnan(phi):
        return F.lit(NAN)
    if phi < 0 or phi > 1:
        return F.lit(-INF if phi < 0 else INF)
    rank = F.lit(phi) * (F.size(values) - 1)
    lo, hi = F.floor(rank).cast("int"), F.ceil(rank).cast("int")
    a, b = F.element_at(values, lo + 1), F.element_at(values, hi + 1)
    return a + (b - a) * (rank - lo)


def _grown(before: Column, now: Column) -> Column:
    """What a counter has grown by; if it fell, it began again at 0."""
    return F.when(now >= before, now - before).otherwise(now)


def _latest(name: str, n: Column, last: Column, before: Column) -> Column:
    """irate and idelta, of the last two samples (ts, value)."""
    if name == "idelta":
        return F.when(n >= 2, last["value"] - before["value"])
    return F.when((n >= 2) & (last["ts"] > before["ts"]), F.try_divide(_grown(before["value"], last["value"]), (last["ts"] - before["ts"]) / 1000.0))


def _extrapolated(name: str, n: Column, first: Column, last: Column, change: Column, step: Column, window: int) -> Column:
    """rate, increase and delta: the change, stretched to the window's ends where samples come close to them."""
    span = (last["ts"] - first["ts"]).cast("double")
    mean = F.try_divide(span, n - 1)
    start, end = (first["ts"] - (step - window)).cast("double"), (step - last["ts"]).cast("double")
    if name != "delta":
        zero = F.try_divide(span * first["value"], change)
        start = F.when((change > 0) & (first["value"] >= 0) & (zero < start), zero).otherwise(start)
    reach = span + F.when(start < mean * 1.1, start).otherwise(mean / 2) + F.when(end < mean * 1.1, end).otherwise(mean / 2)
    factor = F.try_divide(reach, span)
    if name == "rate":
        factor = factor / (window / 1000.0)
    return F.when((n >= 2) & (span > 0), change * factor)


#: Range functions of a window's ends and of sums that grow along a series: no window is gathered for them.
RUNNING = ("rate", "increase", "delta", "irate", "idelta", "count_over_time", "last_over_time", "present_over_time", "changes", "resets")


def running_function(name: str, first: Column, last: Column, step: Column, window: int) -> Column:
    """The same over a window's first and last sample, with what has been counted along the series up to each."""
    n = last["n"] - first["n"] + 1
    if name in ("irate", "idelta"):
        return _latest(name, n, last, last["before"])
    if name == "delta":
        return _extrapolated(name, n, first, last, last["value"] - first["value"], step, window)
    if name in ("rate", "increase"):
        some = lambda k: last[k] > first[k]
        grown = F.when(some("nans") | (some("highs") & some("lows")), NAN).when(some("highs"), INF).when(some("lows"), -INF).otherwise(last["grown"] - first["grown"])
        return _extrapolated(name, n, first, last, grown, step, window)
    simple = {"count_over_time": n.cast("double"), "last_over_time": last["value"], "present_over_time": F.lit(1.0), "changes": (last["changes"] - first["changes"]).cast("double"), "resets": (last["resets"] - first["resets"]).cast("double")}
    return simple[name]


def window_function(name: str, w: Column, step: Column, window: int, arg: float | None) -> Column:
    """A range function over w, the sorted array of (ts, value) of one series and step; NULL drops the sample."""
    n, v = F.size(w), F.transform(w, lambda s: s["value"])
    first, last = w[0], F.element_at(w, -1)
    sums = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    pairs = F.zip_with(F.slice(v, 1, F.greatest(n - 1, F.lit(0))), F.slice(v, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    if name in ("irate", "idelta"):
        return _latest(name, n, last, F.try_element_at(w, F.lit(-2)))
    if name in ("rate", "increase", "delta"):
        change = last["value"] - first["value"] if name == "delta" else sums(F.transform(pairs, lambda p: _grown(p["a"], p["b"])))
        return _extrapolated(name, n, first, last, change, step, window)
    if name in ("deriv", "predict_linear"):
        x = F.transform(w, lambda s: (s["ts"] - step) / 1000.0)

        def moments(m: Column) -> Column:
            cov = sums(F.zip_with(x, v, lambda a, b: (a - m["x"]) * (b - m["y"])))
            var = sums(F.transform(x, lambda a: (a - m["x"]) * (a - m["x"])))
            return F.struct(m["x"].alias("x"), m["y"].alias("y"), var.alias("var"), F.try_divide(cov, var).alias("slope"))

        def value(m: Column) -> Column:
            return F.when(m["var"] != 0, m["slope"] if name == "deriv" else (m["y"] - m["slope"] * m["x"]) + m["slope"] * F.lit(float(arg)))

        return F.when(n >= 2, _let(F.struct((sums(x) / n).alias("x"), (sums(v) / n).alias("y")), lambda m: _let(moments(m), value)))
    real = F.filter(v, lambda x: ~F.isnan(x))
    mean = sums(v) / n
    var = _let(mean, lambda m: sums(F.transform(v, lambda x: (x - m) * (x - m)))) / n
    quantile = lambda a, phi: _let(F.sort_array(a), lambda s: _quantile(s, phi))
    simple = {
        "avg_over_time": lambda: mean, "min_over_time": lambda: F.coalesce(F.array_min(real), F.lit(INF)), "max_over_time": lambda: F.coalesce(F.array_max(real), F.lit(-INF)),
        "sum_over_time": lambda: sums(v), "count_over_time": lambda: n.cast("double"), "last_over_time": lambda: last["value"], "present_over_time": lambda: F.lit(1.0),
        "changes": lambda: F.size(F.filter(pairs, lambda p: p["a"] != p["b"])).cast("double"), "resets": lambda: F.size(F.filter(pairs, lambda p: p["b"] < p["a"])).cast("double"),
        "stddev_over_time": lambda: F.sqrt(var), "stdvar_over_time": lambda: var, "mad_over_time": lambda: _let(quantile(v, 0.5), lambda m: quantile(F.transform(v, lambda x: F.abs(x - m)), 0.5)),
        "quantile_over_time": lambda: quantile(v, arg),
    }
    return F.when(n > 0, simple[name]())


RANGE_FUNCTIONS = (
    "rate", "increase", "delta", "irate", "idelta", "deriv", "predict_linear", "avg_over_time", "min_over_time", "max_over_time", "sum_over_time", "count_over_time",
    "last_over_time", "present_over_time", "changes", "resets", "stddev_over_time", "stdvar_over_time", "mad_over_time", "quantile_over_time",
)


class Evaluator:
    """Evaluates expressions over samples (labels, ts, value) on a grid of steps."""

    def __init__(self, data: DataFrame, grid: Grid):
        self.data, self.grid, self.spark, self.outer = data, grid, data.sparkSession, grid

    def on(self, grid: Grid) -> Evaluator:
        out = Evaluator(self.data, grid)
        out.outer = self.outer
        return out

    # selectors

    def matching(self, sel: Selector) -> DataFrame:
        rows = self.data
        for name, op, value in sel.matchers:
            c = label(name)
            if op in ("=", "!="):
                rows = rows.where(c == value if op == "=" else c != value)
            else:
                hit = c.rlike(f"^(?:{value})\\z")
                rows = rows.where(hit if op == "=~" else ~hit)
        return rows

    def pinned(self, at: object) -> int | None:
        return {"start": self.outer.start, "end": self.outer.end}.get(at, at) if at is not None else None

    def spread(self, rows: DataFrame, reach: int, offset: int, at: object) -> DataFrame:
        """Each sample at every step that it can serve: those within `reach` after it (both ends included)."""
        g, pin = self.grid, self.pinned(at)
        rows = rows.withColumn("ts", F.col("ts") + offset)
        if pin is not None:
            return rows.where((F.col("ts") <= pin) & (F.col("ts") >= pin - reach)).withColumn("eval", F.lit(pin).cast("long")).crossJoin(F.broadcast(g.frame(self.spark)))
        rows = rows.where((F.col("ts") <= g.end) & (F.col("ts") >= g.start - reach))
        first = F.greatest(F.lit(g.start), F.lit(g.start) + F.ceil((F.col("ts") - g.start) / g.step).cast("long") * g.step).cast("long")
        last = F.least(F.lit(g.start) + F.floor((F.col("ts") + reach - g.start) / g.step).cast("long") * g.step, F.lit(g.start + (g.end - g.start) // g.step * g.step)).cast("long")
        rows = rows.withColumn("_a", first).withColumn("_b", last).where("_a <= _b")
        return rows.withColumn("step", F.explode(F.sequence("_a", "_b", F.lit(g.step).cast("long")))).drop("_a", "_b").withColumn("eval", F.col("step"))

    def instant(self, sel: Selector) -> DataFrame:
        rows = self.matching(sel)
        if sel.at is None:
            # of samples that first serve the same step only the last can be seen
            slot = F.ceil((F.col("ts") + sel.offset - self.grid.start) / self.grid.step)
            rows = rows.groupBy("labels", slot.alias("_slot")).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
        rows = self.spread(rows, LOOKBACK, sel.offset, sel.at)
        return rows.groupBy("step", "labels").agg(F.max_by("value", "ts").alias("value"))

    def ranged(self, node: Selector | Subquery) -> DataFrame:
        """The samples (labels, ts, value) that a range is taken of."""
        if isinstance(node, Subquery):
            g, pin = self.grid, self.pinned(node.at)
            low = (g.start if pin is None else pin) - node.offset - node.window
            high = (g.end if pin is None else pin) - node.offset
            inner = Grid(-(-low // node.step) * node.step, high // node.step * node.step, node.step)
            rows = self.on(inner).vector(node.inner).select("labels", F.col("step").alias("ts"), "value")
        else:
            rows = self.matching(node)
        return rows.select("labels", "ts", "value")

    def ends(self, node: Selector | Subquery) -> DataFrame:
        """(step, labels, first, last): the first and the last sample of each series' window, each with what has been
        counted along the series up to it.

        A series is sorted once, with two marks a step among its samples: one before its window's start, one behind its
        end. A mark sees the sample before it, which knows the sample after; so no sample is copied for a step.
        """
        g = self.grid
        rows = self.ranged(node).withColumn("ts", F.col("ts") + node.offset)
        rows = rows.where((F.col("ts") <= g.end) & (F.col("ts") >= g.start - node.window))
        order = W.partitionBy("labels").orderBy("ts", "value")
        so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
        before = F.lag(F.struct("ts", "value")).over(order)
        rows = rows.select("labels", "ts", "value", F.row_number().over(order).alias("n"), before.alias("before"))
        grown = F.coalesce(_grown(F.col("before.value"), F.col("value")), F.lit(0.0))
        grown = F.when(F.col("before").isNull(), 0.0).otherwise(grown)
        odd = F.isnan(grown) | (F.abs(grown) == INF)
        total = lambda c: F.sum(c).over(so_far)
        one = lambda c: total(F.when(c, 1).otherwise(0))
        sample = F.struct(
            "ts", "value", "n", "before", total(F.when(odd, 0.0).otherwise(grown)).alias("grown"), one(F.isnan(grown)).alias("nans"), one(grown == INF).alias("highs"), one(grown == -INF).alias("lows"),
            one(F.col("before.value") != F.col("value")).alias("changes"), one(F.col("value") < F.col("before.value")).alias("resets"),
        )
        samples = rows.select("labels", sample.alias("s"))
        samples = samples.withColumn("state", F.struct("s", F.lead("s").over(W.partitionBy("labels").orderBy("s.n")).alias("next")))
        reach = samples.groupBy("labels").agg(F.min("s.ts").alias("low"), F.max("s.ts").alias("high"), F.min_by("s", "s.n").alias("head"))
        low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("low") - g.start) / g.step).cast("long"))
        high = F.least(F.lit((g.end - g.start) // g.step).cast("long"), F.floor((F.col("high") + node.window - g.start) / g.step).cast("long"))
        steps = reach.where(low <= high).select("labels", "head", F.explode(F.sequence(low, high)).alias("k")).select("labels", "head", (F.col("k") * g.step + g.start).alias("step"))
        ends = F.array(F.struct((F.col("step") - node.window).alias("ts"), F.lit(0).alias("place")), F.struct(F.col("step").alias("ts"), F.lit(2).alias("place")))
        marks = steps.select("labels", "step", "head", F.explode(ends).alias("m")).select("labels", "m.ts", "m.place", "step", "head", F.lit(None).cast(samples.schema["state"].dataType).alias("state"))
        every = samples.select("labels", "s.ts", F.lit(1).alias("place"), F.lit(None).cast("long").alias("step"), F.lit(None).cast(samples.schema["s"].dataType).alias("head"), "state").unionByName(marks)
        along = W.partitionBy("labels").orderBy("ts", "place", "state.s.n").rowsBetween(W.unboundedPreceding, W.currentRow)
        seen = every.withColumn("seen", F.last("state", True).over(along)).where("step is not null")
        first = F.when(F.col("place") == 0, F.when(F.col("seen").isNull(), F.col("head")).otherwise(F.col("seen.next")))
        last = F.when(F.col("place") == 2, F.col("seen.s"))
        return seen.groupBy("labels", "step").agg(F.first(first, True).alias("first"), F.first(last, True).alias("last")).where("last.n >= first.n").select("step", "labels", "first", "last")

    def windows(self, node: Selector | Subquery) -> DataFrame:
        """(step, eval, labels, w) with the sorted samples of each series' window."""
        rows = self.spread(self.ranged(node), node.window, node.offset, node.at)
        return rows.groupBy("step", "eval", "labels").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("w"))

    # expressions

    def eval(self, e):
        """A float, a frame (step, value) marked scalar, or a vector frame."""
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    def vector(self, e) -> DataFrame:
        out = self.eval(e)
        if isinstance(out, float):
            return self.grid.frame(self.spark).select("step", F.array().cast("array<struct<k:string,v:string>>").alias("labels"), F.lit(out).alias("value"))
        return out if "labels" in out.columns else out.select("step", F.array().cast("array<struct<k:string,v:string>>").alias("labels"), "value")

    def _number(self, e: Number):
        return e.value

    def _selector(self, e: Selector):
        if e.window is not None:
            raise ValueError("a range vector needs a function")
        return self.instant(e)

    def _negate(self, e: Negate):
        x = self.eval(e.inner)
        return -x if isinstance(x, float) else self.unnamed(x).withColumn("value", -F.col("value"))

    def unnamed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("labels", without(["__name__"])) if "labels" in df.columns else df

    def number(self, e) -> float:
        x = self.eval(e)
        if not isinstance(x, float):
            raise ValueError("a constant is needed here")
        return x

    def _call(self, e: Call):
        name, a = e.name, e.args
        if name in RANGE_FUNCTIONS:
            arg = None
            if name == "quantile_over_time":
                arg, a = self.number(a[0]), a[1:]
            elif name == "predict_linear":
                arg = self.number(a[1])
            if name in RUNNING and a[0].at is None:
                rows = self.ends(a[0]).withColumn("value", running_function(name, F.col("first"), F.col("last"), F.col("step"), a[0].window)).where("value is not null")
            else:
                rows = self.windows(a[0]).withColumn("value", window_function(name, F.col("w"), F.col("eval"), a[0].window, arg)).where("value is not null")
            rows = rows.select("step", "labels", "value")
            return rows if name == "last_over_time" else self.unnamed(rows)
        if name == "time":
            return self.grid.frame(self.spark).select("step", (F.col("step") / 1000.0).alias("value"))
        if name == "vector":
            return self.vector(a[0])
        if name == "scalar":
            v = self.vector(a[0]).groupBy("step").agg(F.when(F.count(F.lit(1)) == 1, F.max("value")).otherwise(NAN).alias("v"))
            return self.grid.frame(self.spark).join(v, "step", "left").select("step", F.coalesce("v", F.lit(NAN)).alias("value"))
        if name == "timestamp":
            if isinstance(a[0], Selector):
                rows = self.spread(self.matching(a[0]), LOOKBACK, a[0].offset, a[0].at)
                return self.unnamed(rows.groupBy("step", "labels").agg((F.max("ts") / 1000.0 - a[0].offset / 1000.0).alias("value")))
            return self.unnamed(self.vector(a[0])).withColumn("value", F.col("step") / 1000.0)
        if name in ("absent", "absent_over_time"):
            have = (self.windows(a[0]) if name == "absent_over_time" else self.vector(a[0])).select("step").distinct()
            matchers = a[0].matchers if isinstance(a[0], Selector) else []
            eq = {n: v for n, op, v in matchers if op == "=" and n != "__name__" and sum(m[0] == n for m in matchers) == 1}
            return self.grid.frame(self.spark).join(have, "step", "left_anti").select("step", entries({k: F.lit(v) for k, v in eq.items()}).alias("labels") if eq else F.array().cast("array<struct<k:string,v:string>>").alias("labels"), F.lit(1.0).alias("value"))
        if name in MATH:
            x = self.eval(a[0]) if a else self._call(Call("time", []))
            if not a:
                x = x.select("step", F.array().cast("array<struct<k:string,v:string>>").alias("labels"), "value")
            if isinstance(x, float):
                x = self.vector(Number(x))
            return self.unnamed(x).withColumn("value", MATH[name](F.col("value")))
        if name == "round":
            to = self.number(a[1]) if len(a) > 1 else 1.0
            v = F.col("value") / to
            away = F.signum(v) * F.floor(F.abs(v) + 0.5)
            return self.unnamed(self.vector(a[0])).withColumn("value", F.when(F.isnan("value") | (F.abs("value") == INF), F.col("value")).otherwise(away * to))
        if name in ("clamp", "clamp_min", "clamp_max"):
            low = self.number(a[1]) if name != "clamp_max" else -INF
            high = self.number(a[-1]) if name != "clamp_min" else INF
            c = F.when(F.isnan("value"), NAN).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), F.col("value"))))
            return self.unnamed(self.vector(a[0])).withColumn("value", F.lit(NAN) if low > high else c)
        if name == "label_replace":
            dst, to, src, pattern = (x.value for x in a[1:])
            value, full = label(src), f"^(?:{pattern})\\z"
            made = F.regexp_replace(value, full, re.sub(r"\$\{(\w+)\}", r"$\1", to))
            return self.vector(a[0]).withColumn("labels", F.when(value.rlike(full), with_label(F.col("labels"), dst, made)).otherwise(F.col("labels")))
        if name == "label_join":
            dst, sep, *src = (x.value for x in a[1:])
            return self.vector(a[0]).withColumn("labels", with_label(F.col("labels"), dst, F.concat_ws(sep, *(label(s) for s in src))))
        if name in ("sort", "sort_desc"):
            v = self.vector(a[0])
            return v.orderBy("step", F.col("value").asc_nulls_last() if name == "sort" else F.col("value").desc_nulls_first(), "labels")
        if name == "histogram_quantile":
            return histogram_quantile(self.vector(a[1]), self.number(a[0]))
        raise ValueError(f"unknown function {name}")

    def _aggregate(self, e: Aggregate):
        arg = e.args[0] if len(e.args) > 1 else None
        v = self.vector(e.args[-1])
        keep = only(e.labels) if e.by else without([*e.labels, "__name__"])
        if e.name in ("topk", "bottomk"):
            k = int(self.number(arg))
            order = F.col("value").desc() if e.name == "topk" else F.col("value").asc()
            rank = F.row_number().over(W.partitionBy("step", "_g").orderBy(F.isnan("value").asc(), order, "labels"))
            return v.withColumn("_g", keep).withColumn("_r", rank).where(F.col("_r") <= k).drop("_g", "_r")
        v = v.select("step", keep.alias("labels"), "value")
        if e.name == "count_values":
            text = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
            v = v.withColumn("labels", with_label(F.col("labels"), arg.value, text))
            return v.groupBy("step", "labels").agg(F.count(F.lit(1)).cast("double").alias("value"))
        real = F.when(~F.isnan("value"), F.col("value"))
        made = {
            "sum": lambda: F.sum("value"), "avg": lambda: F.avg("value"), "min": lambda: F.coalesce(F.min(real), F.lit(NAN)), "max": lambda: F.coalesce(F.max(real), F.lit(NAN)),
            "count": lambda: F.count(F.lit(1)).cast("double"), "group": lambda: F.max(F.lit(1.0)), "stddev": lambda: F.stddev_pop("value"), "stdvar": lambda: F.var_pop("value"),
        }
        if e.name == "quantile":
            phi = self.number(arg)
            value = F.percentile("value", phi) if 0 <= phi <= 1 else F.max(F.lit(NAN if math.isnan(phi) else -INF if phi < 0 else INF))
        else:
            value = made[e.name]()
        return v.groupBy("step", "labels").agg(value.alias("value"))

    def _binary(self, e: Binary):
        left, right = self.eval(e.left), self.eval(e.right)
        is_vector = lambda x: not isinstance(x, float) and "labels" in x.columns
        if not is_vector(left) and not is_vector(right):
            return self.scalars(e, left, right)
        if e.op in ("and", "or", "unless"):
            return self.sets(e, self.vector(e.left), self.vector(e.right))
        if is_vector(left) and is_vector(right):
            return self.vectors(e, left, right)
        vector, scalar, flipped = (left, right, False) if is_vector(left) else (right, left, True)
        if isinstance(scalar, float):
            rows, s = vector, F.lit(scalar)
        else:
            rows, s = vector.join(F.broadcast(scalar.select("step", F.col("value").alias("_s"))), "step"), F.col("_s")  # at most MAX_STEPS rows
        a, b = (s, F.col("value")) if flipped else (F.col("value"), s)
        if e.op in COMPARISONS:
            test = comparison(e.op, a, b)
            if not e.bool_:
                return rows.where(test).select("step", "labels", "value")
            return self.unnamed(rows.withColumn("value", test.cast("double")).select("step", "labels", "value"))
        return self.unnamed(rows.withColumn("value", ieee(e.op, a, b)).select("step", "labels", "value"))

    def scalars(self, e: Binary, a, b):
        if e.op in COMPARISONS and not e.bool_:
            raise ValueError("comparing scalars needs bool")
        frame = self.grid.frame(self.spark)
        one = isinstance(a, float) and isinstance(b, float)
        for x, name in ((a, "a"), (b, "b")):
            frame = frame.withColumn(name, F.lit(x)) if isinstance(x, float) else frame.join(x.select("step", F.col("value").alias(name)), "step")
        c = comparison(e.op, F.col("a"), F.col("b")).cast("double") if e.op in COMPARISONS else ieee(e.op, F.col("a"), F.col("b"))
        if one:
            return float(self.spark.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("b")).select(c.alias("v")).first().v)  # folds a constant
        return frame.select("step", c.alias("value"))

    def key(self, e: Binary) -> Column:
        return only(e.on) if e.on is not None else without([*e.ignoring, "__name__"])

    def sets(self, e: Binary, a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.withColumn("_k", self.key(e)), b.withColumn("_k", self.key(e))
        if e.op == "or":
            return a.unionByName(b.join(a.select("step", "_k").distinct(), ["step", "_k"], "left_anti").select(*a.columns)).drop("_k")
        return a.join(b.select("step", "_k").distinct(), ["step", "_k"], "left_semi" if e.op == "and" else "left_anti").select("step", "labels", "value")

    def vectors(self, e: Binary, left: DataFrame, right: DataFrame) -> DataFrame:
        many, one = (right, left) if e.group == "group_right" else (left, right)
        many = many.withColumn("_k", self.key(e))
        one = one.withColumn("_k", self.key(e)).select("step", "_k", F.col("labels").alias("_l"), F.col("value").alias("_v"))
        same = lambda w, what: F.when(F.count(F.lit(1)).over(w) > 1, F.raise_error(F.lit(f"many-to-many matching: several series of one key on the {what} side")))
        w = W.partitionBy("step", "_k")
        one = one.withColumn("_e", same(w, "'one'").cast("string")).where("_e is null").drop("_e")
        if e.group is None:
            many = many.withColumn("_e", same(w, "left").cast("string")).where("_e is null").drop("_e")
        rows = many.join(one, ["step", "_k"])
        a, b = (F.col("_v"), F.col("value")) if e.group == "group_right" else (F.col("value"), F.col("_v"))
        labels = F.col("labels")
        for g in e.graft:
            labels = with_label(labels, g, label(g, "_l"))
        if e.group is None:
            plain = only(e.on) if e.on is not None else without([*e.ignoring, "__name__"])
        else:
            plain = without(["__name__"], labels)
        if e.op in COMPARISONS:
            test = comparison(e.op, a, b)
            if not e.bool_:
                return rows.where(test).select("step", labels.alias("labels"), a.alias("value"))
            return rows.select("step", plain.alias("labels"), test.cast("double").alias("value"))
        return rows.select("step", plain.alias("labels"), ieee(e.op, a, b).alias("value"))


def histogram_quantile(v: DataFrame, phi: float) -> DataFrame:
    """Linear interpolation in cumulative buckets `le`, made monotone first."""
    rows = v.withColumn("_le", F.when(label("le").isin("+Inf", "Inf"), F.lit(INF)).otherwise(label("le").try_cast("double"))).where("_le is not null")
    rows = rows.withColumn("labels", without(["le", "__name__"]))
    rows = rows.groupBy("step", "labels").agg(F.array_sort(F.collect_list(F.struct(F.col("_le").alias("le"), F.col("value").alias("c")))).alias("b"))
    if math.isnan(phi) or not 0 <= phi <= 1:
        return rows.select("step", "labels", F.lit(NAN if math.isnan(phi) else -INF if phi < 0 else INF).alias("value"))
    # counts become running maxima
    start = F.struct(F.array().cast("array<struct<le:double,c:double>>").alias("out"), F.lit(0.0).alias("m"))
    run = F.aggregate("b", start, lambda s, x: F.struct(F.concat(s["out"], F.array(F.struct(x["le"].alias("le"), F.greatest(s["m"], x["c"]).alias("c")))).alias("out"), F.greatest(s["m"], x["c"]).alias("m")))
    rows = rows.withColumn("b", run["out"]).withColumn("n", F.size("b")).withColumn("total", F.element_at("b", -1)["c"])
    rows = rows.withColumn("rank", F.lit(phi) * F.col("total")).withColumn("i", F.least(F.size(F.filter("b", lambda x: x["c"] < F.col("rank"))), F.col("n") - 1))
    here, before = F.element_at("b", F.col("i") + 1), F.try_element_at("b", F.when(F.col("i") > 0, F.col("i")))
    low, under = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["c"], F.lit(0.0))
    inner = F.when(here["c"] <= under, here["le"]).otherwise(low + (here["le"] - low) * F.try_divide(F.col("rank") - under, here["c"] - under))
    value = F.when((F.col("n") < 2) | (F.element_at("b", -1)["le"] != INF), NAN).when(~(F.col("total") > 0) | F.isnan("total"), NAN)
    value = value.when(here["le"] == INF, low).otherwise(inner)
    return rows.select("step", "labels", value.alias("value"))


def _out(df: DataFrame) -> DataFrame:
    return df.select(F.col("step").alias("step_ms"), F.map_from_entries("labels").alias("labels"), "value")


def query_range(data: DataFrame, query: str, start: int, end: int, step: int) -> DataFrame:
    """step_ms, labels and value of each series at each step; times in ms."""
    if step <= 0 or end < start:
        raise ValueError("needs step > 0 and end >= start")
    return _out(Evaluator(data, Grid(start, end, step)).vector(parse(query)))


def query(data: DataFrame, text: str, time: int) -> DataFrame:
    return query_range(data, text, time, time, 1)


def label_names(data: DataFrame) -> DataFrame:
    return data.select(F.explode("labels").alias("e")).select(F.col("e.k").alias("label")).distinct()


def label_values(data: DataFrame, name: str) -> DataFrame:
    return data.select(label(name).alias("value")).where("value <> ''").distinct()


def series(data: DataFrame, *selectors: str) -> DataFrame:
    ev = Evaluator(data, Grid(0, 0, 1))
    out = None
    for s in selectors:
        part = ev.matching(parse(s)).select("labels")
        out = part if out is None else out.unionAll(part)
    return out.distinct().select(F.map_from_entries("labels").alias("labels"))
