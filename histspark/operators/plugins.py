"""Plugin steps: DataFrame -> DataFrame hooks around the write path, and actions by type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns a step may not touch.
SIGNED = ("tenant", "collection", "entity_id", "version", "op", "changes", "author", "source", "ts_source", "flow")
Step = Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """Pre-store and post-store steps in registration order, and actions by type."""

    pre: list[tuple[str, Step, str]] = field(default_factory=list)
    post: list[tuple[str, Step]] = field(default_factory=list)
    actions: dict[str, Step] = field(default_factory=dict)

    def pre_store(self, name: str, step: Step, fail_mode: str = "open") -> None:
        """Register a step; ``fail_mode`` open keeps rows whose step reports ``plugin_error``, as they were before it; closed
        rejects them."""
        if fail_mode not in ("open", "closed"):
            raise ValueError("fail mode is open or closed")
        self.pre.append((name, step, fail_mode))

    def post_store(self, name: str, step: Step) -> None:
        self.post.append((name, step))

    def action(self, kind: str, step: Step) -> None:
        if kind in self.actions:
            raise ValueError(f"action {kind!r} is registered")
        self.actions[kind] = step

    def run_pre_store(self, events: DataFrame, enabled: dict[str, list[str]]) -> DataFrame:
        """Run each step for the collections that enable it; adds ``reject_code`` and ``plugin_errors`` (name:error).

        A step works row by row; it sees all rows, and what it does to rows of other collections, or to rows rejected
        before, does not count, so that the plan stays one chain without a branch per step. A step may change other columns, set ``reject`` or ``plugin_error``; a step that changes a signed column is an error
        of that row. A row with an error keeps nothing of the step: all its columns are what they were.
        """
        out = events.withColumns({"reject_code": F.lit(None).cast("string"), "plugin_errors": F.array().cast("array<string>")})
        for name, step, mode in self.pre:
            on = [c for c, names in enabled.items() if name in names]
            if not on:
                continue
            mine = F.coalesce(F.col("_was.collection").isin(on), F.lit(False)) & F.col("_was.reject_code").isNull()
            done = step(out.withColumn("_was", F.struct(*out.columns)))
            for c in ("reject", "plugin_error"):
                if c not in done.columns:
                    done = done.withColumn(c, F.lit(None).cast("string"))
            touched = F.lit(False)
            for c in (c for c in SIGNED if c in out.columns):
                touched = touched | ~F.col(c).eqNullSafe(F.col(f"_was.{c}"))
            done = done.withColumn("_error", F.when(touched, "signed_column_changed").otherwise(F.col("plugin_error")))
            wrong = mine & F.col("_error").isNotNull()
            kept = {c: F.when(mine & ~wrong, F.col(c)).otherwise(F.col(f"_was.{c}")) for c in out.columns}
            kept["plugin_errors"] = F.when(wrong, F.array_append("_was.plugin_errors", F.concat(F.lit(name + ":"), F.col("_error")))).otherwise(F.col("_was.plugin_errors"))
            kept["reject_code"] = F.when(wrong, F.lit("plugin_error" if mode == "closed" else None).cast("string")).when(mine, F.col("reject")).otherwise(F.col("_was.reject_code"))
            out = done.select(*[v.alias(c) for c, v in kept.items()])
        return out

    def run_post_store(self, events: DataFrame) -> None:
        """Called behind an append, e.g. in foreachBatch."""
        for _, step in self.post:
            step(events)

    def run_actions(self, matches: DataFrame) -> dict[str, DataFrame]:
        """Rows of each registered action type, through its step."""
        return {kind: step(matches.where(F.col("type") == kind)) for kind, step in self.actions.items()}


def plugin_error_counts(rows: DataFrame) -> DataFrame:
    """Errors by plugin."""
    return rows.select(F.explode("plugin_errors").alias("e")).groupBy(F.substring_index("e", ":", 1).alias("plugin")).agg(F.count("*").alias("n"))
