"""Two places a screen can keep its intermediate values.

A screen is written once, as a series of named SQL expressions. ``Rows`` puts each of them in a column of a DataFrame, so
a value used twice is computed once and the work stays in generated code. ``Parts`` puts them in fields of the structs of
an array column, so all messages of one chat body are screened without exploding, shuffling and regrouping the bodies.

Expressions are SQL text because the word lists are long: one text crosses to the JVM at once, where the same expression
built from Column objects takes thousands of calls.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

Ref = Callable[[str], str]
Maker = Callable[[Ref], str]


def long_table(df: DataFrame, keys: Sequence[str], items: str, never_null: str) -> DataFrame:
    """One row per struct of the array column ``items``, none where it is empty.

    The inner form of ``inline`` makes the optimizer filter on the size of the array first, and push that filter below
    everything the array is computed from, which would compute it twice. The outer form and a filter on its result do not.
    """
    return df.select(*keys, F.inline_outer(items)).filter(F.col(never_null).isNotNull())


class Rows:
    """Values are columns. Steps are gathered as nested SELECTs and handed over as one statement."""

    def __init__(self, df: DataFrame, **start: Column):
        self.kept = df.columns
        self._df = df.withColumns({self.ref(k): c for k, c in start.items()})
        self._known = set(start)
        self._steps: list[str] = []

    @staticmethod
    def ref(name: str) -> str:
        return f"__screen_{name}"

    def bind(self, **makers: Maker) -> None:
        if not makers:
            return
        again = ", ".join(self.ref(name) for name in makers if name in self._known)
        made = ", ".join(f"{make(self.ref)} AS {self.ref(name)}" for name, make in makers.items())
        self._steps.append(f"SELECT *{f' EXCEPT ({again})' if again else ''}, {made} FROM")
        self._known |= set(makers)

    @property
    def df(self) -> DataFrame:
        if self._steps:
            statement = "{rows}"
            for step in self._steps:
                statement = f"({step} {statement})"
            self._df = self._df.sparkSession.sql(
                "SELECT * FROM " + statement.replace("{", "{{").replace("}", "}}").replace("{{rows}}", "{rows}"),
                rows=self._df)
            self._steps = []
        return self._df

    def bind_column(self, name: str, make: Callable[[Column], Column], source: str, otherwise: str | None = None) -> None:
        """A user's own column function of one value, for the rows not blocked yet."""
        made = F.when(F.col(self.ref("reason")).isNull(), make(F.col(self.ref(source))))
        self._df = self.df.withColumn(self.ref(name), made if otherwise is None
                                      else made.otherwise(F.col(self.ref(otherwise))))
        self._known.add(name)

    def result(self, **names: str) -> DataFrame:
        """The input columns plus the named values (output name = value name).

        The values leave through ``inline``. A filter on them (``not blocked``, say) would otherwise be pushed below all
        projections, each of which names the one before several times: the condition would grow without bound, and
        every screen would run twice.
        """
        kept = [c for c in self.kept if c not in names]
        values = F.struct(*[F.col(self.ref(v)).alias(k) for k, v in names.items()])
        order = [*self.kept, *(n for n in names if n not in self.kept)]
        return self.df.select(*kept, F.inline(F.array(values))).select(*order)


class Parts:
    """Values are fields of the structs in the array column ``items``."""

    def __init__(self, df: DataFrame, items: str, fields: list[str]):
        self.df, self.items, self.fields = df, items, list(fields)

    @staticmethod
    def ref(name: str) -> str:
        return f"p.{name}"

    def bind(self, **makers: Maker) -> None:
        made = {name: make(self.ref) for name, make in makers.items()}
        self.fields += [name for name in made if name not in self.fields]
        pairs = ", ".join(f"'{name}', {made.get(name, self.ref(name))}" for name in self.fields)
        self.df = self.df.withColumn(self.items, F.expr(f"transform({self.items}, p -> named_struct({pairs}))"))

    def bind_column(self, name: str, make: Callable[[Column], Column], source: str, otherwise: str | None = None) -> None:
        def stage(p: Column) -> Column:
            made = F.when(p["reason"].isNull(), make(p[source]))
            return p.withField(name, made if otherwise is None else made.otherwise(p[otherwise]))

        self.fields += [name] if name not in self.fields else []
        self.df = self.df.withColumn(self.items, F.transform(F.col(self.items), stage))
