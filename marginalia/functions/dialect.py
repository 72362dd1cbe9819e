"""The few SQL forms in which Spark and DuckDB differ, so that a query and its check are written once."""

from __future__ import annotations

import re

# Letters that Spark writes as several capitals, or as capitals that DuckDB does not know, and what one letter of each becomes.
LONG = [c for c in map(chr, range(0x10000)) if len(c.upper()) > 1]
NEWER = "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))
CAPITALS = {c: "\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in LONG} | {c: c for c in NEWER}
# End of fixed values.


class Spark:
    name = "spark"

    def text(self, value: str) -> str:
        """A string literal, taken as it stands."""
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def like(self, s: str, pattern: str) -> str:
        return f"regexp_like({s}, {self.text(pattern)})"

    def upper(self, s: str) -> str:
        """Capitals letter by letter, as DuckDB writes them: a text keeps its length."""
        odd = "".join(CAPITALS)
        one = f"case when {self.like('y', f'^[{odd}]+$')} then translate(y, '{odd}', '{''.join(CAPITALS.values())}') else upper(y) end"
        return f"case when {self.like(s, f'[{odd}]')} then array_join(transform({self.extract_all(s, f'[{odd}]+|[^{odd}]+')}, y -> {one}), '') else upper({s}) end"

    def extract(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({s}, {self.text(pattern)}, {group})"

    def extract_all(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.text(pattern)}, {group})"

    def sub(self, s: str, pattern: str, new: str = "") -> str:
        return f"regexp_replace({s}, {self.text(pattern)}, {self.text(re.sub(r'\\(\d)', r'$\1', new))})"

    def count(self, s: str, pattern: str) -> str:
        return f"cast(regexp_count({s}, {self.text(pattern)}) as bigint)"

    def split(self, s: str, pattern: str) -> str:
        return f"split({s}, {self.text(pattern)}, -1)"

    def join(self, value: str, sep: str, order: str, where: str = "") -> str:
        value = f"case when {where} then {value} end" if where else value
        return f"listagg({value}, {self.text(sep)}) within group (order by {order})"

    def each(self, source: str, array: str, columns: str) -> str:
        """A row for each element x of the array, pos from 0 on; columns are plain names of the source. The view is an outer one, as of an
        inner one Spark infers a filter that works the array out a second time."""
        return f"select {columns}, pos, x from (select {columns}, {array} arr from {source}) lateral view outer posexplode(arr) e as pos, x where pos is not null"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def compact(self, *items: str) -> str:
        return f"array_compact(array({', '.join(items)}))"

    def collect(self, value: str, order: str, where: str = "true") -> str:
        """Values in the given order; value and order are columns."""
        return f"transform(array_sort(collect_list(case when {where} then struct({order} as o, {value} as v) end)), y -> y.v)"

    def distinct(self, value: str, where: str = "true") -> str:
        return f"array_sort(collect_set(case when {where} then {value} end))"

    def slice(self, array: str, n: int) -> str:
        return f"slice({array}, 1, {n})"

    def array_join(self, array: str, sep: str) -> str:
        return f"array_join({array}, {self.text(sep)})"

    def even(self, x: str) -> str:
        """Rounded half to even."""
        return f"bround({x}, 0)"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def number(self, s: str) -> str:
        return f"try_cast({s} as double)"


class Duck(Spark):
    name = "duck"

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def like(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {self.text(pattern)})"

    def upper(self, s: str) -> str:
        return f"upper({s})"

    def sub(self, s: str, pattern: str, new: str = "") -> str:
        return f"regexp_replace({s}, {self.text(pattern)}, {self.text(new)}, 'g')"

    def count(self, s: str, pattern: str) -> str:
        return f"cast(len(regexp_extract_all({s}, {self.text(pattern)})) as bigint)"

    def split(self, s: str, pattern: str) -> str:
        return f"string_split_regex({s}, {self.text(pattern)})"

    def join(self, value: str, sep: str, order: str, where: str = "") -> str:
        return f"string_agg({value}, {self.text(sep)} order by {order})" + (f" filter (where {where})" if where else "")

    def each(self, source: str, array: str, columns: str) -> str:
        return f"select {columns}, unnest(range(len(arr))) pos, unnest(arr) x from (select {columns}, {array} arr from {source})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def compact(self, *items: str) -> str:
        return f"list_filter([{', '.join(items)}], lambda y: y is not null)"

    def collect(self, value: str, order: str, where: str = "true") -> str:
        return f"coalesce(list({value} order by {order}) filter (where {where}), [])"

    def distinct(self, value: str, where: str = "true") -> str:
        return f"coalesce(list_sort(list(distinct {value}) filter (where {where} and {value} is not null)), [])"

    def slice(self, array: str, n: int) -> str:
        return f"{array}[1:{n}]"

    def array_join(self, array: str, sep: str) -> str:
        return f"array_to_string({array}, {self.text(sep)})"

    def even(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


SPARK, DUCK = Spark(), Duck()
