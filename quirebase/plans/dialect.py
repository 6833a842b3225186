"""The few words in which Spark's SQL and DuckDB's differ, so that one plan can be stated once for engine and oracle.

Patterns are written without backslashes: both engines then read the same expression.
"""

from __future__ import annotations

from collections.abc import Callable


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def rx(self, s: str, p: str) -> str:
        return f"regexp_like({s}, '{p}')" if self.spark else f"regexp_matches({s}, '{p}')"

    def sub(self, s: str, p: str, r: str) -> str:
        return f"regexp_replace({s}, '{p}', '{r}')" if self.spark else f"regexp_replace({s}, '{p}', '{r}', 'g')"

    def found(self, s: str, p: str, group: int = 0) -> str:
        """The list of a pattern's matches."""
        return f"regexp_extract_all({s}, '{p}', {group})"

    def pat(self, p: str) -> str:
        """A pattern with § for each backslash, as the engine's literals write it."""
        return p.replace("§", chr(92) * (2 if self.spark else 1))

    def trim(self, s: str) -> str:
        """Without white space around."""
        return self.sub(s, self.pat("^§s+|§s+$"), "")

    def collapsed(self, s: str) -> str:
        return f"trim({self.sub(s, self.pat('§s+'), ' ')})"

    def words(self, a: str, but: list[str]) -> str:
        """Distinct items of a list, sorted, without some."""
        kept = self.only(a, "x NOT IN (" + ", ".join(f"'{w}'" for w in but) + ")") if but else a
        return f"array_sort(array_distinct({kept}))" if self.spark else f"list_sort(list_distinct({kept}))"

    def any(self, a: str, f: str) -> str:
        return f"exists({a}, x -> {f})" if self.spark else f"(len(list_filter({a}, lambda x: {f})) > 0)"

    def json(self, s: str) -> str:
        """A text is JSON, with nothing behind it."""
        return f"(coalesce(json_array_length('[' || {s} || ']'), 0) = 1 AND try_parse_json('{{\"v\": ' || {s} || '}}') IS NOT NULL)" if self.spark else f"json_valid({s})"

    def split(self, s: str, p: str) -> str:
        return f"split({s}, '{p}', -1)" if self.spark else f"regexp_split_to_array({s}, '{p}')"

    def size(self, a: str) -> str:
        return f"size({a})" if self.spark else f"CAST(len({a}) AS INTEGER)"

    def count(self, s: str, p: str) -> str:
        return self.size(self.found(s, p))

    def each(self, a: str, f: str) -> str:
        return f"transform({a}, x -> {f})" if self.spark else f"list_transform({a}, lambda x: {f})"

    def only(self, a: str, f: str) -> str:
        return f"filter({a}, x -> {f})" if self.spark else f"list_filter({a}, lambda x: {f})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {sep})" if self.spark else f"array_to_string({a}, {sep})"

    def glue(self, v: str, sep: str, by: str) -> str:
        """Ordered string aggregation."""
        return f"coalesce(listagg({v}, {sep}) WITHIN GROUP (ORDER BY {by}), {chr(39) * 2})" if self.spark else f"coalesce(string_agg({v}, {sep} ORDER BY {by}), '')"

    def even(self, x: str, n: int) -> str:
        return f"bround({x}, {n})" if self.spark else f"round_even({x}, {n})"

    def ints(self, a: str, b: str) -> str:
        return f"explode(sequence({a}, {b}))" if self.spark else f"unnest(range({a}, {b} + 1))"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def at(self, a: str, i: int) -> str:
        """Element i, from 0."""
        return f"{a}[{i if self.spark else i + 1}]"

    def ranked(self, order: list[str], item: str) -> str:
        """Aggregate: lists of one item each, in order."""
        if self.spark:
            return f"transform(array_sort(collect_list(struct({', '.join(f'{o} AS o{i}' for i, o in enumerate(order))}, {item} AS item))), s -> array(s.item))"
        return f"list([{item}] ORDER BY {', '.join(order)})"

    def fold(self, a: str, f: str) -> str:
        """f of acc and e over a list, acc being its first element at first."""
        return f"aggregate({a}, {a}[0], (acc, e) -> {f})" if self.spark else f"list_reduce({a}, lambda acc, e: {f})"

    def merged(self, *names: str) -> str:
        """For a SELECT whose joins Spark is to sort and merge: rows made by explode are more than its estimates say, too many to broadcast."""
        return f"/*+ MERGE({', '.join(names)}) */ " if self.spark else ""

    def settled(self, keys: str) -> str:
        """Further keys of an ORDER BY that leaves ties open, for Spark alone: any choice is within the oracle's statement, this one is always the same. Column stored is a row's place in its table."""
        return f", {keys}" if self.spark else ""

    def spread(self, cols: str, a: str, src: str) -> str:
        if self.spark:
            return f"SELECT {cols}, pos, b FROM {src} LATERAL VIEW posexplode({a}) v AS pos, b"
        return f"SELECT {cols}, CAST(unnest(range(len({a}))) AS INTEGER) AS pos, unnest({a}) AS b FROM {src}"

    def sha256(self, s: str) -> str:
        return f"sha2({s}, 256)" if self.spark else f"sha256({s})"

    def lines(self, src: str = "documents") -> str:
        """v_blocks: each line of a document as a layout block (id, order, text, geometry by modulo)."""
        tail = "CAST(10 AS DOUBLE) AS x, CAST(blk * 12 AS DOUBLE) AS y, CAST(200 + (doc_id * 7 + blk * 13) % 300 AS DOUBLE) AS w, CAST(10 + (doc_id + blk) % 9 AS DOUBLE) AS h"
        if self.spark:
            return f"SELECT doc_id, lang, source, blk, text, {tail} FROM (SELECT doc_id, lang, source, pos AS blk, line AS text FROM {src} LATERAL VIEW posexplode(split(text, chr(10))) q AS pos, line)"
        return f"SELECT doc_id, lang, source, blk, text, {tail} FROM (SELECT doc_id, lang, source, CAST(unnest(range(len(l))) AS INTEGER) AS blk, unnest(l) AS text FROM (SELECT doc_id, lang, source, split(text, chr(10)) AS l FROM {src}))"


SPARK, DUCK = Dialect(True), Dialect(False)
Plan = Callable[[Dialect], str]
