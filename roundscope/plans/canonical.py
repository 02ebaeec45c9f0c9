"""From landing rows to the canonical tables of every match.

``CanonicalMatches`` takes raw event rows and round markers and gives the tables that the statistics read: matches, teams, players, memberships, rounds
and six event families.  Rows are cleaned, rounds and outcomes resolved, players identified, teams voted and events assigned, in this order; each step is
a DataFrame over all matches.  With a ``keep`` function the rows, their roles, the rounds and the player facts are written once, as several
later steps read them.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import identity as D
from ..operators import normalize as B
from ..operators import rounds as C

TABLES = ("matches", "teams", "players", "memberships", "rounds", *B.FAMILIES)


class CanonicalMatches:
    """Canonical tables as attributes; ``raw(match_id, source_event, data)``, ``marks`` as in ``operators.rounds``."""

    def __init__(self, raw: DataFrame, marks: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df):
        self.raw, self.keep = raw, keep
        self.marks = marks

    @cached_property
    def rows(self) -> DataFrame:
        return self.keep(B.stable_rows(self.raw), "rows")

    @cached_property
    def roles(self) -> DataFrame:
        return self.keep(B.role_rows(self.rows), "roles")

    @cached_property
    def boundaries(self) -> DataFrame:
        """Rounds by their markers, before teams and outcomes are known."""
        r = C.resolve_rounds(self.marks).withColumn("round_id", F.concat("match_id", F.lit("-r"), F.col("round_number").cast("string")))
        none = F.lit(None).cast("string")
        return self.keep(r.withColumn("t_team_id", none).withColumn("ct_team_id", none), "boundaries")

    @cached_property
    def seen(self) -> DataFrame:
        """Counted side observations of every player and round."""
        return self.keep(D.count_observations(D.side_observations(self.roles, self.boundaries)), "seen")

    @cached_property
    def first_sides(self) -> DataFrame:
        return D.first_sides(self.seen)

    @cached_property
    def teams(self) -> DataFrame:
        return self.keep(D.seed_teams(self.first_sides), "teams")

    @cached_property
    def player_teams(self) -> DataFrame:
        return self.keep(D.player_teams(self.seen, self.first_sides, self.teams), "player_teams")

    @cached_property
    def sides(self) -> DataFrame:
        return D.resolve_sides(self.boundaries, self.seen, self.player_teams, self.teams)

    @cached_property
    def memberships(self) -> DataFrame:
        return self.keep(D.membership_intervals(self.sides, self.player_teams), "memberships")

    @cached_property
    def players(self) -> DataFrame:
        return self.keep(D.player_identities(self.roles).join(self.player_teams, ["match_id", "player_id"], "left"), "players")

    @cached_property
    def rounds(self) -> DataFrame:
        sides = self.sides.select("match_id", "round_number", "t_team_id", "ct_team_id", "side_certain", F.col("is_overtime").alias("overtime"))
        r = self.boundaries.drop("t_team_id", "ct_team_id").join(sides, ["match_id", "round_number"])
        o = C.resolve_outcomes(self.boundaries, self.marks)
        proven = F.col("outcome_status").isin("source_event", "derived_from_authoritative_score_delta")
        status = F.when(proven, "available").when(F.col("outcome_status") == "unresolved_conflict", "unresolved_conflict").otherwise("missing")
        score = F.when(F.col("score_status") == "available", "available").otherwise("missing")
        r = r.join(o, ["match_id", "round_number"]).withColumn("is_overtime", F.col("overtime")).drop("overtime")
        return self.keep(r.withColumn("outcome_source", F.col("outcome_status")).withColumn("outcome_status", status).withColumn("score_status", score)
                         .withColumn("is_warmup", F.lit(False)), "rounds")

    @cached_property
    def matches(self) -> DataFrame:
        counts = C.round_count(self.marks)
        n = self.rounds.groupBy("match_id").agg(F.count("*").alias("round_count"), F.count_if("is_complete").alias("complete_round_count"))
        return self.keep(counts.join(n, "match_id", "left"), "matches")

    @cached_property
    def events(self) -> DataFrame:
        """All rows with a tick: round, phase, and each role's player, team and side."""
        located = self.boundaries
        return self.keep(B.normalize_events(self.rows, self.roles, located, D.player_spans(self.player_teams, self.memberships)), "events")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in B.FAMILIES:
            raise AttributeError(name)
        out = self.keep(B.FAMILIES[name](self.events), name)
        setattr(self, name, out)
        return out
