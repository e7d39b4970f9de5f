"""The vector operations of recording rules written as SQL, for the checking database.

A vector is a named CTE with columns ``labels`` (a map) and ``value``.
"""

from __future__ import annotations

KEY = "array_to_string(list_transform(list_sort(map_keys(labels)), lambda k: k || '=' || labels[k]), ',')"
EMPTY = "cast(map_from_entries([]) as map(varchar, varchar))"


def lab(name: str) -> str:
    return f"coalesce(labels['{name}'], '')"


def as_map(names: list[str], source: dict[str, str] | None = None) -> str:
    if not names:
        return EMPTY
    items = ", ".join(f"{{'k': '{n}', 'v': {(source or {}).get(n, chr(34) + n + chr(34))}}}" for n in names)
    return f"map_from_entries(list_filter([{items}], lambda x: x.v <> ''))"


class SqlRules:
    """Builds CTEs; every method returns the name of the vector it made."""

    def __init__(self, now: str, lookback: int):
        self.now, self.lookback = now, lookback
        self.ctes: list[str] = []
        self.recorded: dict[str, str] = {}

    def add(self, text: str) -> str:
        name = f"x{len(self.ctes)}"
        self.ctes.append(f"{name} as materialized ({text})")
        return name

    def m(self, name, *matchers):
        conds = []
        for label, op, want in matchers:
            hit = f"{lab(label)} = '{want}'" if op in ("=", "!=") else f"regexp_full_match({lab(label)}, '{want}')"
            conds.append(f"not ({hit})" if op.startswith("!") else hit)
        src = self.recorded.get(name)
        if src is None:
            src = "inst"
            conds.append(f"metric = '{name}'")
        return self.add(f"select labels, value from {src}" + (" where " + " and ".join(conds) if conds else ""))

    def _counter(self, name, window, per_second):
        us = window * 1_000_000
        end = f"epoch_us(timestamp '{self.now}')"
        return self.add(f"""
          with r as (select *, {KEY} as key, epoch_us(ts) as t from samples where metric = '{name}' and epoch_us(ts) > {end} - {us} and epoch_us(ts) <= {end}),
          d as (select *, lag(value) over (partition by key order by t) as p from r),
          g as (select any_value(labels) as labels, sum(case when value < p then value else value - p end) as x, count(*) as n, min(t) as t0, max(t) as t1, arg_min(value, t) as v0 from d group by key having count(*) >= 2),
          e as (select *, (t1 - t0) / 1e6::double as span, (t1 - t0) / 1e6::double / (n - 1) as gap, {window} - ({end} - t0) / 1e6::double as lead0, ({end} - t1) / 1e6::double as trail0 from g),
          f as (select *, least(case when lead0 >= 1.1 * gap then gap / 2 else lead0 end, coalesce(case when x > 0 and v0 >= 0 then span * v0 / x end, 1e18)) as lead, case when trail0 >= 1.1 * gap then gap / 2 else trail0 end as trail from e)
          select labels, x * (span + lead + trail) / span / {window if per_second else 1} as value from f""")

    def rate(self, name, window):
        return self._counter(name, window, True)

    def increase(self, name, window):
        return self._counter(name, window, False)

    def _by(self, v, fn, by):
        cols = ", ".join(f'{lab(b)} as "{b}"' for b in by)
        if not by:
            return self.add(f"select {EMPTY} as labels, {fn} as value from {v} having count(*) > 0")
        return self.add(f"select {as_map(by)} as labels, value from (select {cols}, {fn} as value from {v} group by all)")

    def agg(self, v, how, by):
        fn = {"stddev": "stddev_pop(value)", "count": "count(value)::double"}.get(how, f"{how}(value)")
        return self._by(v, fn, by)

    def quantile(self, v, q, by):
        return self._by(v, f"quantile_cont(value, {q})", by)

    def _key(self, alias, on):
        key = KEY.replace("labels", f"{alias}.labels") if on is None else "concat_ws('|', " + ", ".join(lab(o).replace("labels", f"{alias}.labels") for o in on) + ")"
        return key

    def op(self, a, sign, b, on=None):
        expr = "a.value / nullif(b.value, 0)" if sign == "/" else f"a.value {sign} b.value"
        labels = "a.labels" if on is None else as_map(on, {o: lab(o).replace("labels", "a.labels") for o in on})
        return self.add(f"select {labels} as labels, {expr} as value from {a} a join {b} b on {self._key('a', on)} = {self._key('b', on)}")

    def enrich(self, many, one, on, extra):
        keep = "list_filter(map_entries(a.labels), lambda x: x.key not in (" + ", ".join(f"'{e}'" for e in extra) + "))"
        took = "list_filter(map_entries(b.labels), lambda x: x.key in (" + ", ".join(f"'{e}'" for e in extra) + ") and x.value <> '')"
        return self.add(f"select map_from_entries({keep} || {took}) as labels, a.value * b.value as value from {many} a join {one} b on {self._key('a', on)} = {self._key('b', on)}")

    def both(self, a, b, on):
        return self.add(f"select * from {a} a where {self._key('a', on)} in (select {self._key('b', on)} from {b} b)")

    def unless(self, a, b, on):
        return self.add(f"select * from {a} a where {self._key('a', on)} not in (select {self._key('b', on)} from {b} b)")

    def either(self, a, b):
        rest = self.unless(b, a, None)
        return self.add(f"select labels, value from {a} union all select labels, value from {rest}")

    def gt(self, v, x):
        return self.add(f"select * from {v} where value > {x}")

    def lt(self, v, x):
        return self.add(f"select * from {v} where value < {x}")

    def _value(self, v, expr):
        return self.add(f"select labels, {expr} as value from {v}")

    def scale(self, v, k):
        return self._value(v, f"value * {k}::double")

    def const(self, v, k):
        return self._value(v, f"{k}::double")

    def age(self, v):
        return self._value(v, f"epoch_us(timestamp '{self.now}') / 1e6::double - value")

    def clamp(self, v, floor):
        return self._value(v, f"greatest(value, {floor})")

    def sqrt(self, v):
        return self._value(v, "sqrt(value)")

    def relabel(self, v, copies, fixed=None):
        dst = [*copies, *(fixed or {})]
        keep = "list_filter(map_entries(labels), lambda x: x.key not in (" + ", ".join(f"'{d}'" for d in dst) + "))"
        items = [f"{{'key': '{d}', 'value': case when {lab(s)} <> '' then {lab(s)} else {lab(d)} end}}" for d, s in copies.items()]
        items += [f"{{'key': '{d}', 'value': '{x}'}}" for d, x in (fixed or {}).items()]
        return self.add(f"select map_from_entries(list_filter({keep} || [{', '.join(items)}], lambda x: x.value <> '')) as labels, value from {v}")

    def top1(self, v, by):
        part = ", ".join(lab(b) for b in by)
        return self.add(f"select labels, value from (select *, row_number() over (partition by {part} order by value desc, {KEY}) as rn from {v}) where rn = 1")

    def at_least_zero(self, v):
        return self._value(v, "case when value >= 0 then 1.0 else 0.0 end::double")

    def or_zero(self, v):
        return self.add(f"select {EMPTY} as labels, coalesce(max(value), 0)::double as value from {v}")

    def bucket_quantile(self, v, q):
        rest = "map_from_entries(list_filter(map_entries(labels), lambda x: x.key <> 'le'))"
        return self.add(f"""
          with b as (select {rest} as labels, case when {lab('le')} = '+Inf' then 'inf'::double else {lab('le')}::double end as le, value as c from {v}),
          k as (select *, {KEY} as key from b),
          w as (select *, lag(c) over (partition by key order by le) as pc, lag(le) over (partition by key order by le) as pl, last_value(c) over (partition by key order by le rows between unbounded preceding and unbounded following) * {q} as r,
             last_value(le) over (partition by key order by le rows between unbounded preceding and unbounded following) as ml, count(*) over (partition by key) as nb from k),
          h as (select *, row_number() over (partition by key order by le) as rn from w where c >= r)
          select labels, case when isinf(le) then coalesce(pl, 0) when pl is null and le <= 0 then le else coalesce(pl, 0) + (le - coalesce(pl, 0)) * (r - coalesce(pc, 0)) / nullif(c - coalesce(pc, 0), 0) end as value
          from h where rn = 1 and isinf(ml) and nb > 1 and r > 0""")


def rule_sql(samples: str, rules, now: str, lookback: int) -> str:
    """One statement that evaluates a rule group; ``samples`` is a SELECT of (metric, labels, ts, value)."""
    e = SqlRules(now, lookback)
    outs = []
    for name, fn in rules:
        e.recorded[name] = fn(e)
        outs.append(f"select '{name}' as metric, {KEY} as labels, round(value, 9) as value from {e.recorded[name]}")
    inst = f"""inst as materialized (select metric, any_value(labels) as labels, arg_max(value, ts) as value from samples
       where ts > timestamp '{now}' - interval {lookback} second and ts <= timestamp '{now}' group by metric, {KEY})"""
    return "with samples as materialized (" + samples + "),\n" + ",\n".join([inst, *e.ctes]) + "\n" + " union all ".join(outs)
