"""Standing questions: registered plans whose answers are kept and made again only when their inputs changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.sources.snapshots import VersionedTable


@dataclass(frozen=True)
class Question:
    """A name, the questions and tables it is made of, and how."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    aliases: tuple[str, ...] = field(default=())


class Ambiguous(LookupError):
    """A name that could mean several questions, or none."""


class StandingQuestions:
    """A catalog of questions over named tables, with their answers in versioned tables below a folder."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> None:
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.questions: dict[str, Question] = {}
        self.signed: dict[str, str] = {}

    def register(self, question: Question) -> None:
        """Adds a question; its inputs must be tables or questions that are there, so the questions are a graph without cycles."""
        missing = [i for i in question.inputs if i not in self.tables and i not in self.questions]
        if missing or question.name in self.questions or question.name in self.tables:
            raise ValueError(f"cannot register {question.name}: {missing or 'the name is taken'}")
        self.questions[question.name] = question

    def route(self, asked: str) -> Question:
        """The question of exactly this name, else the only one of this alias."""
        if asked in self.questions:
            return self.questions[asked]
        found = [q for q in self.questions.values() if asked.strip().lower() in {a.lower() for a in q.aliases}]
        if len(found) != 1:
            raise Ambiguous(asked)
        return found[0]

    def signature(self, name: str) -> str:
        """A digest of what a question or table is made of: of the files of a table (names, sizes, times), which are listed and not read.

        Only the rows of a table that comes from no files are digested themselves, whatever their order.
        """
        if name in self.questions:
            return json.dumps([name, *(self.signature(i) for i in self.questions[name].inputs)])
        rows = self.tables[name]
        files = rows.inputFiles()
        if files:
            seen = []
            for f in files:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(f)
                status = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(where)
                seen.append(f"{f}:{status.getLen()}:{status.getModificationTime()}")
            return f"{name}:{hashlib.sha256(chr(10).join(sorted(seen)).encode()).hexdigest()}"
        r = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("x"), F.sum(F.pmod(F.xxhash64(*rows.columns), F.lit(2**31 - 1))).alias("s")).collect()[0]
        return f"{name}:{r.n}:{r.x}:{r.s}"

    def certificate(self, asked: str) -> dict:
        """What an answer was made of: its name and version, the signature of its inputs, and the names of the tables behind it."""
        question = self.route(asked)
        tables: set[str] = set()
        waiting = list(question.inputs)
        while waiting:
            name = waiting.pop()
            if name in self.questions:
                waiting += self.questions[name].inputs
            else:
                tables.add(name)
        version = VersionedTable(self.spark, f"{self.path}/{question.name}").current()
        return {"question": question.name, "version": version, "signature": self.signed.get(question.name), "tables": sorted(tables), "current": self.signed.get(question.name) == self.signature(question.name)}

    def read(self, asked: str) -> DataFrame:
        """The answer; made again, with what it depends on, only if an input changed since it was made."""
        question = self.route(asked)
        store = VersionedTable(self.spark, f"{self.path}/{question.name}")
        signature = self.signature(question.name)
        if self.signed.get(question.name) != signature:
            inputs = [self.read(i) if i in self.questions else self.tables[i] for i in question.inputs]
            store.promote(store.stage(question.make(*inputs)))
            self.signed[question.name] = signature
        return store.read()

    def history(self, asked: str) -> list[int]:
        """The versions of an answer, oldest first; each can be read as VersionedTable.read(version)."""
        return VersionedTable(self.spark, f"{self.path}/{self.route(asked).name}").versions()

    def affected(self, changed: set[str]) -> list[str]:
        """Which questions a change of tables makes stale, in the order they are to be made again."""
        stale = set(changed)
        out = []
        for q in self.questions.values():  # registered after their inputs, so one pass is enough
            if stale & set(q.inputs):
                stale.add(q.name)
                out.append(q.name)
        return out


def patched(blocks: list[dict], operation: str, at: int | None = None, block: dict | None = None, revision: int | None = None, expected: int | None = None) -> list[dict]:
    """A page's blocks after an append, insert, replace or remove, if the page still has the expected revision."""
    if expected is not None and revision != expected:
        raise ValueError(f"the page is at revision {revision}, not {expected}")
    out = list(blocks)
    if operation == "append":
        out.append(block)
    elif operation == "insert":
        out.insert(at, block)
    elif operation == "replace":
        out[at] = block
    elif operation == "remove":
        del out[at]
    else:
        raise ValueError(operation)
    return out
