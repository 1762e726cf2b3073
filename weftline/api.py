"""One object over the graph's tables, with the calls that users make."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import targets
from .operators import audit, categories, graph, lines, rank, search, views
from .plugins import Events
from .sources import catalog, ingest, parsers
from .streaming import streams


@dataclass
class CodeGraph:
    """Tables of a scanned project. What isn't given is derived from ``files``, with the
    parsers ``known`` by extension (those of the library, or of a plugin registry)."""

    files: DataFrame
    tag: str = "@note"
    known: dict | None = None
    events: Events | None = None

    def _tell(self, event: str, payload) -> None:
        if self.events:
            self.events.emit(event, payload)

    def tell_changes(self, changes: DataFrame) -> None:
        """Emits node:add, file:change and node:remove, with path and lines, for a batch of changes (see ``operators.edits``).

        A row a changed path comes to the driver, as handlers run there; streams go to a sink instead.
        """
        if self.events:
            for r in streams.watch_events(changes, self.files).toLocalIterator():
                self.events.emit(r["event"], {"path": r["path"], "lines": r["lines"]})

    @classmethod
    def scan(cls, spark: SparkSession, root: str, **how) -> CodeGraph:
        return cls(ingest.read_files(spark, root, **how))

    @classmethod
    def load(cls, spark: SparkSession, path: str, root: str) -> CodeGraph | None:
        tables = catalog.load(spark, path, root)
        if tables is None:
            return None
        loaded = cls(tables.pop("files"))
        for name, df in tables.items():
            loaded.__dict__[name] = df
        return loaded

    def save(self, path: str, root: str) -> None:
        catalog.save(self.tables(), path, root)

    @cached_property
    def symbols(self) -> DataFrame:
        return parsers.symbols(self.files, self.known)

    @cached_property
    def imports(self) -> DataFrame:
        return parsers.imports(self.files)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.resolve_imports(self.imports, self.files)

    @cached_property
    def calls(self) -> DataFrame:
        return graph.resolve_calls(parsers.raw_calls(self.files, self.known), self.edges, self.symbols)

    @cached_property
    def annotations(self) -> DataFrame:
        return parsers.annotations(self.files, self.tag)

    @cached_property
    def categorised(self) -> DataFrame:
        return parsers.categorised(self.files, self.tag)

    @cached_property
    def directories(self) -> DataFrame:
        return lines.directories(self.files)

    def search(self, query: str, **how) -> DataFrame:
        found = search.search(self.files, self.symbols, search.SearchRequest(query, **how))
        self._tell("search:executed", {"query": query, "hits": found})
        return found

    def search_in_files(self, query: str, **how) -> DataFrame:
        scores = self.find_relevant(query).select("path", "score")
        return search.content_search(self.files, self.symbols, query, scores, **how)

    def find_relevant(self, goal: str, top_n: int | None = None) -> DataFrame:
        return rank.relevance(self.files, goal, self.symbols, self.annotations, self.categorised, top_n=top_n)

    def find_by_name(self, glob: str) -> DataFrame:
        return search.find_by_name(self.files, glob)

    def files_by_directory(self, directory: str) -> DataFrame:
        return self.files.where(F.col("dir_path") == directory)

    def dependencies(self, target: str) -> DataFrame:
        return graph.dependencies(self.edges, self.calls, self.files, target)

    def impact(self, target: str, depth: int = 2) -> DataFrame:
        return graph.impact(self.edges, self.calls, target, depth)

    def traverse(self, start: str, direction: str = "imports", max_depth: int = 3) -> DataFrame:
        return graph.traverse(self.edges, start, direction, max_depth, known=self.files)

    def related(self, path: str) -> DataFrame:
        return graph.related(self.edges, self.files, path)

    def stats(self) -> DataFrame:
        return graph.stats(self.files, self.directories, self.symbols, self.edges, self.calls)

    def audit(self, rules: list[audit.Rule], rule_id: str | None = None) -> DataFrame:
        return audit.audit(audit.Catalog(self.files, self.imports, self.edges, self.annotations), rules, rule_id)

    def peek(self, path: str, content: bool = False, **stores) -> DataFrame:
        """One row on a file; ``stores`` are the tables of groups, members, notations, labels and assignments that there are."""
        stores.setdefault("annotations", self.annotations)
        stores.setdefault("domains", parsers.domains(self.categorised))
        return views.peek(self.files, path, self.edges, self.symbols, self.calls, content=content, **stores)

    def find_for_goal(self, goal: str, page: int = 1, size: int = 10, tables: dict[str, DataFrame] | None = None):
        return categories.find_for_goal(self.files, goal, self.symbols, self.annotations, self.categorised, page, size, tables)

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in ("files", "symbols", "imports", "edges", "calls", "annotations")}

    def rescan(self, spark: SparkSession, root: str, **how) -> CodeGraph:
        """The graph of what is there now; files that are as they were aren't read."""
        return CodeGraph(ingest.rescan(spark, root, self.files, **how), self.tag, self.known, self.events)

    def after(self, changes: DataFrame) -> CodeGraph:
        """The graph after a batch of changes (see ``operators.edits``)."""
        new = streams.apply_changes(self.tables(), changes, streams.parse_files(self.tag, self.known))
        graph_ = CodeGraph(new.pop("files"), self.tag, self.known, self.events)
        graph_.__dict__.update(new)
        return graph_

    def with_symbols(self, more: DataFrame) -> CodeGraph:
        """With symbols that a plugin found."""
        return self._with(symbols=self.symbols.unionByName(more, allowMissingColumns=True).select(*self.symbols.columns))

    def with_dependencies(self, more: DataFrame) -> CodeGraph:
        """With edges (src, dst) that a plugin found."""
        return self._with(edges=graph.with_edges(self.edges, more))

    def _with(self, **tables) -> CodeGraph:
        new = CodeGraph(self.files, self.tag, self.known, self.events)
        new.__dict__.update({k: v for k, v in self.__dict__.items() if k not in ("calls", *tables)} | tables)
        return new

    def orientation(self, labels: DataFrame, assignments: DataFrame, topics: DataFrame, items: DataFrame, log: DataFrame, contributions: DataFrame | None = None) -> DataFrame:
        self._tell("orient:contribute", contributions)
        return views.orient(self.stats(), labels, assignments, topics, items, log, contributions)

    def read(self, target: str) -> DataFrame:
        """path and content of a file, of its lines a to b, or of a symbol."""
        t = targets.resolve(target)
        if t.type == "symbol":
            return lines.symbol_content(self.files, self.symbols, t.path, t.symbol)
        own = self.files.where(F.col("path") == t.path)
        content = lines.exact_range(F.col("content"), t.start, t.end) if t.type == "range" else F.col("content")
        found = own.select("path", content.alias("content"))
        self._tell("read:result:after", {"target": target, "rows": found})
        return found
