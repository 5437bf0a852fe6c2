"""XML task payloads as tag rows, and tag rows as XML.

Spark reads XML of a known layout; payloads have any layout, so reading a document
and writing one are small Python helpers that work on Arrow batches inside tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The helpers below travel with the tasks that use them, so executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TAG_COLUMNS = "ordinal int, tag_key string, tag_parent string, tag_value string"
# Characters up to the blank count as white space around a value.
_BLANKS = "".join(chr(code) for code in range(33))


def read_tags(text: str) -> list[tuple[str, str, str | None]]:
    """(key, parent, value) of every element in document order.

    The root is its own parent; only elements without child elements have a value.
    Raises ``expat.ExpatError`` for a text that is no well-formed document.
    """
    tags: list[list] = []
    open_tags: list[int] = []
    texts: list[list[str]] = []

    def qualified(name: str) -> str:
        parts = name.split(" ")
        return f"{parts[2]}:{parts[1]}" if len(parts) == 3 else parts[-1]

    def start(name: str, _: dict) -> None:
        key = qualified(name)
        parent = tags[open_tags[-1]][0] if open_tags else key
        if open_tags:
            tags[open_tags[-1]][2] = None
            texts[-1] = None
        tags.append([key, parent, ""])
        open_tags.append(len(tags) - 1)
        texts.append([])

    def characters(data: str) -> None:
        if texts and texts[-1] is not None:
            texts[-1].append(data)

    def end(_: str) -> None:
        at, text_parts = open_tags.pop(), texts.pop()
        if text_parts is not None:
            tags[at][2] = "".join(text_parts).strip(_BLANKS)

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.namespace_prefixes = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = characters
    parser.Parse(text, True)
    return [tuple(tag) for tag in tags]


def _tags_or_none(text: str | None) -> list[tuple[str, str, str | None]] | None:
    try:
        return read_tags(text) if text else None
    except expat.ExpatError:
        return None


@F.pandas_udf(T.BooleanType())
def _well_formed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: _tags_or_none(text) is not None)


def well_formed(payload: Column) -> Column:
    """Whether the text is a well-formed XML document."""
    return _well_formed(payload)


def payload_flatten(tasks: DataFrame, key: str = "task_detail_id", column: str = "task_payload") -> DataFrame:
    """One row per element of each payload: key, ordinal from 1, tag, parent and value.

    A payload that is empty or cannot be read gives no rows.
    """

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (owner, place, *tag)
                for owner, text in zip(batch[key], batch[column])
                for place, tag in enumerate(_tags_or_none(text) or (), start=1)
            ]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "tag_key", "tag_parent", "tag_value"])

    owner_type = tasks.schema[key].dataType.simpleString()
    chosen = tasks.select(key, column).where(F.col(column).isNotNull())
    return chosen.mapInPandas(flatten, f"{key} {owner_type}, {TAG_COLUMNS}")


class _Document:
    """An XML document built tag by tag.

    A tag goes under the element of its parent's name that comes last in the document.
    An element's place is the path of child numbers from the root; children are only
    ever added at the end, so places stay valid and the last one is the greatest.
    """

    def __init__(self) -> None:
        self.root: list | None = None
        self.last: dict[str, tuple[tuple[int, ...], list]] = {}

    def _add(self, parent: list | None, place: tuple[int, ...], name: str, value: str | None) -> list:
        element = [name, value or "", []]
        if parent is not None:
            parent[2].append(element)
        if name not in self.last or place > self.last[name][0]:
            self.last[name] = (place, element)
        return element

    def add(self, name: str | None, parent: str | None, value: str | None) -> None:
        if self.root is None:
            self.root = self._add(None, (), name, value)
        elif not parent:
            self._add(self.root, (len(self.root[2]),), name, value)
        elif name and parent in self.last:
            place, element = self.last[parent]
            self._add(element, (*place, len(element[2])), name, value)
        elif name:
            place = (len(self.root[2]),)
            created = self._add(self.root, place, parent, None)
            self._add(created, (*place, 0), name, value)

    def text(self) -> str:
        parts: list[str] = []
        waiting: list = [self.root]
        while waiting:
            element = waiting.pop()
            if isinstance(element, str):
                parts.append(element)
                continue
            name, value, children = element
            if not value and not children:
                parts.append(f"<{name}/>")
                continue
            parts.append(f"<{name}>{escape(value)}")
            waiting.append(f"</{name}>")
            waiting.extend(reversed(children))
        return "".join(parts)


def payload_build(tags: DataFrame, key: str = "payload_id", order: str = "task_payload_id") -> DataFrame:
    """One XML text per task from its tag rows in tag order.

    Rows are shuffled by task and sorted, then read as a stream: a task holds the one
    document it is writing and never a whole group of rows.
    """
    columns = [key, "tag_key", "tag_parent", "tag_value"]

    def build(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, document = None, None
        for batch in batches:
            done = []
            for row_owner, tag, parent, value in batch[columns].itertuples(index=False, name=None):
                if document is None or row_owner != owner:
                    if document is not None:
                        done.append((owner, document.text()))
                    owner, document = row_owner, _Document()
                document.add(tag, parent, value)
            if done:
                yield pd.DataFrame(done, columns=[key, "task_payload"])
        if document is not None:
            yield pd.DataFrame([(owner, document.text())], columns=[key, "task_payload"])

    owner_type = tags.schema[key].dataType.simpleString()
    ordered = (
        tags.select(*columns, order)
        .where(F.col(key).isNotNull())
        .repartition(key)
        .sortWithinPartitions(key, order)
        .select(*columns)
    )
    return ordered.mapInPandas(build, f"{key} {owner_type}, task_payload string")
