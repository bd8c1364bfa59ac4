"""An optional batch source for bars behind a REST service, as a Python data source.

``spark.dataSource.register(RestBars)``, then ``spark.read.format("rest_bars").options(url=..., symbols="A,B",
start="2024-01-01", end="2024-02-01", timeframe="1Min", key_file=...).load()``. Each symbol is a partition. The key
file (JSON with "key" and "secret", or "api_key" and "api_secret") is read on the executors and never becomes an
option's value. The service answers with JSON: a list of bars with t, o, h, l, c, v, n, vw and a next_page_token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barspark.sources.bars import BAR_SCHEMA


def load_keys(path: str) -> tuple[str, str]:
    """(key, secret) from a JSON file in one of two spellings; ValueError if neither fits."""
    with open(path) as f:
        found = json.load(f)
    for names in (("key", "secret"), ("api_key", "api_secret")):
        if all(found.get(n) for n in names):
            return found[names[0]], found[names[1]]
    raise ValueError("the key file names no key and secret")


def parse_day(value: str | date) -> datetime:
    """Midnight of a day given as %Y-%m-%d or as a date."""
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.strptime(value, "%Y-%m-%d")


def answer_of(url: str, query: dict, head: dict | None = None) -> dict:
    """The JSON object that the service answers with; ValueError where it is something else."""
    with urlopen(Request(f"{url}?{urlencode(query)}", headers=head or {}), timeout=60) as answer:
        found = json.load(answer)
    if not isinstance(found, dict):
        raise ValueError("the service did not answer with an object")
    return found


class _Symbol(InputPartition):
    def __init__(self, symbol: str) -> None:
        self.symbol = symbol


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in dict(options).items()}

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s.strip()) for s in self.options["symbols"].split(",") if s.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        opts = self.options
        head = {}
        if "key_file" in opts:
            key, secret = load_keys(opts["key_file"])
            head = {"X-Key": key, "X-Secret": secret}
        token = None
        while True:
            query = {"symbol": partition.symbol, "start": parse_day(opts["start"]).isoformat(), "end": parse_day(opts["end"]).isoformat(), "timeframe": opts.get("timeframe", "1Min")}
            page = answer_of(opts["url"], query | ({"page_token": token} if token else {}), head)
            for b in page.get("bars") or []:
                yield partition.symbol, datetime.fromisoformat(b["t"]), b["o"], b["h"], b["l"], b["c"], b["v"], b["n"], b["vw"]
            token = page.get("next_page_token")
            if not token:
                return


class RestBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_bars"

    def schema(self) -> str:
        return BAR_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _QuoteReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        opts = self.options
        query = {"symbol": partition.symbol} | ({"function": opts["function"]} if "function" in opts else {})
        if "key_file" in opts:
            query["apikey"] = load_keys(opts["key_file"])[0]
        for name, value in sorted(answer_of(opts["url"], query).items()):
            yield partition.symbol, name, value if isinstance(value, str) or value is None else json.dumps(value)


class RestQuotes(DataSource):
    """Quotes or company overviews, one JSON object a symbol, as rows (symbol, field, value).

    ``spark.read.format("rest_quotes").options(url=..., symbols="A,B", function="OVERVIEW", key_file=...).load()``;
    ``scalars.to_decimal`` makes numbers of the values.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_quotes"

    def schema(self) -> str:
        return "symbol string, field string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _QuoteReader(self.options)
