"""A table service's rows as a Spark data source: ranges of a key read at once, filters answered by the service.

The service answers ``GET url/table?select=a,b&col=eq.5&order=key.asc&limit=n``
with a JSON array.  Its filters are ``eq. neq. gt. gte. lt. lte. in.(...)
is.null like.``, each with ``not.`` in front if turned, and ``or=(...)``.

    spark.dataSource.register(TableService)
    spark.read.format("table_service").schema("id bigint, name string").options(url=..., table="cards", key="id", least=0, most=40000, partitions=32).load()

Every partition reads a range of a unique integer key in pages that go on behind
the page before's last key, so rows that come or go meanwhile shift no page, and
a task that runs again reads its range again.  Spark's filters that the grammar
can say are pushed (``spark.sql.python.filterPushdown.enabled``); the others stay
in Spark.  Columns are those of the schema: give the ones that are needed.  Rows
outside ``least`` to ``most`` are read by the first and the last range.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

#: Attempts of a request; what the client did wrong isn't tried again, too many requests are.
ATTEMPTS, FIRST_WAIT = 4, 1.0
COMPARED = {D.EqualTo: "eq", D.GreaterThan: "gt", D.GreaterThanOrEqual: "gte", D.LessThan: "lt", D.LessThanOrEqual: "lte"}
_RESERVED = set(',.:()"\\')


def literal(value: object, listed: bool = False) -> str | None:
    """A value in the grammar; null where it has no exact form.  Listed values with reserved characters are quoted."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | str):
        text = str(value)
        return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"' if listed and (not text or _RESERVED & set(text)) else text
    return value.isoformat() if hasattr(value, "isoformat") else None


def _pattern(text: str) -> str | None:
    """A part of a pattern; texts with the pattern's own characters aren't pushed."""
    return None if set("%_*\\") & set(text) else text


def condition(f: D.Filter) -> tuple[str, str] | None:
    """A filter as (column, operator and value); null if the grammar can't say it, or says it otherwise."""
    turned = isinstance(f, D.Not)
    inner = f.child if turned else f
    if len(getattr(inner, "attribute", ())) != 1:
        return None
    said: str | None = None
    if type(inner) in COMPARED:
        value = literal(inner.value)
        said = None if value is None else f"{COMPARED[type(inner)]}.{value}"
    elif isinstance(inner, D.In):
        values = [literal(v, True) for v in inner.value]
        said = None if not values or None in values else f"in.({','.join(values)})"
    elif isinstance(inner, D.IsNull | D.IsNotNull):
        said = "is.null" if isinstance(inner, D.IsNull) else "not.is.null"
        return None if turned else (inner.attribute[0], said)
    elif isinstance(inner, D.StringStartsWith | D.StringEndsWith | D.StringContains):
        part = _pattern(inner.value)
        before, after = ("" if isinstance(inner, D.StringStartsWith) else "*"), ("" if isinstance(inner, D.StringEndsWith) else "*")
        said = None if part is None else f"like.{before}{part}{after}"
    return None if said is None else (inner.attribute[0], "not." * turned + said)


@dataclass
class KeyRange(D.InputPartition):
    """Keys from ``least`` (included) to ``most`` (left out); an open end is null."""

    least: int | None
    most: int | None


def ranges(least: int, most: int, parts: int) -> list[KeyRange]:
    """Even ranges of the key; the first and the last are open."""
    parts = max(1, min(parts, most - least + 1))
    cuts = [least + (most - least + 1) * i // parts for i in range(1, parts)]
    return [KeyRange(a, b) for a, b in zip([None, *cuts], [*cuts, None])]


def fetched(url: str, headers: dict[str, str], wait: float = FIRST_WAIT) -> list[dict]:
    """A page; server errors, lost connections and too many requests are tried again, each time after twice as long."""
    for attempt in range(ATTEMPTS):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as error:
            if (error.code < 500 and error.code != 429) or attempt == ATTEMPTS - 1:
                raise RuntimeError(f"{url}: {error.code} {error.read(500).decode(errors='replace')}") from None
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == ATTEMPTS - 1:
                raise
        time.sleep(wait * 2**attempt)
    raise AssertionError


class ServiceReader(D.DataSourceReader):
    """Reads ranges of the key; see the module."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, dict(options)
        self.key = options["key"]
        self.where: list[tuple[str, str]] = [tuple(p.split("=", 1)) for p in options.get("where", "").split("&") if p]

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            said = condition(f)
            if said is None:
                yield f
            else:
                self.where.append(said)

    def partitions(self) -> list[KeyRange]:
        o = self.options
        return ranges(int(o.get("least", 0)), int(o.get("most", 0)), int(o.get("partitions", 1)))

    def _page(self, part: KeyRange, behind: int | None) -> list[dict]:
        o = self.options
        names = self.schema.fieldNames()
        asked = [("select", ",".join(names if self.key in names else [*names, self.key])), *self.where]
        if behind is not None:
            asked.append((self.key, f"gt.{behind}"))
        elif part.least is not None:
            asked.append((self.key, f"gte.{part.least}"))
        if part.most is not None:
            asked.append((self.key, f"lt.{part.most}"))
        asked += [("order", f"{self.key}.asc"), ("limit", o.get("pagesize", "1000"))]
        headers = {k.removeprefix("header."): v for k, v in o.items() if k.startswith("header.")}
        return fetched(f"{o['url'].rstrip('/')}/{o['table']}?{urllib.parse.urlencode(asked)}", headers, float(o.get("wait", FIRST_WAIT)))

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

        import datetime as dt

        readers = {DateType: dt.date.fromisoformat, TimestampType: dt.datetime.fromisoformat, TimestampNTZType: dt.datetime.fromisoformat}
        fields = [(f.name, readers.get(type(f.dataType))) for f in self.schema.fields]
        behind: int | None = None
        while True:
            page = self._page(partition, behind)
            for row in page:
                yield tuple(v if (v := row.get(n)) is None or read is None else read(v) for n, read in fields)
            if len(page) < int(self.options.get("pagesize", "1000")):
                return
            behind = page[-1][self.key]


class TableService(D.DataSource):
    """See the module; the schema is given by the reader's user."""

    @classmethod
    def name(cls) -> str:
        return "table_service"

    def reader(self, schema: StructType) -> ServiceReader:
        return ServiceReader(schema, {k.lower(): v for k, v in self.options.items()})
