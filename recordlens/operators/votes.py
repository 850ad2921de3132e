"""Voting records: participation, contested votes, agreement between members."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contested(votes: DataFrame) -> DataFrame:
    """vote, yes, no, margin of votes with both yes and no; ``votes`` is (vote, member, cast)."""
    n = votes.groupBy("vote").agg(F.count_if(F.col("cast") == "yes").alias("yes"), F.count_if(F.col("cast") == "no").alias("no"))
    return n.where("yes > 0 and no > 0").withColumn("margin", F.abs(F.col("yes") - F.col("no")))


def record(votes: DataFrame) -> DataFrame:
    """Per member: votes, no votes, minority votes, contested votes, not voting, and their rates."""
    c = contested(votes).withColumn("losing", F.when(F.col("yes") < F.col("no"), "yes").when(F.col("no") < F.col("yes"), "no"))
    v = votes.join(c.select("vote", "losing", F.lit(True).alias("contested")), "vote", "left")
    cast_ = F.col("cast").isin("yes", "no")
    out = v.groupBy("member").agg(
        F.count_if(cast_).alias("votes"),
        F.count_if(F.col("cast") == "no").alias("no_votes"),
        F.count_if(cast_ & F.col("contested")).alias("contested"),
        F.count_if(F.col("cast") == F.col("losing")).alias("minority"),
        F.count_if(~cast_).alias("not_voting"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return out.withColumns({"no_rate": rate("no_votes", "votes"), "minority_rate": rate("minority", "contested")})


def agreement(votes: DataFrame, least: int = 5) -> DataFrame:
    """Members a < b with at least ``least`` common contested votes, and the share on which they agree.

    The self join is on the vote, so its rows are bounded by the size of the body, not by the number of votes.
    """
    v = votes.where(F.col("cast").isin("yes", "no")).join(contested(votes).select("vote"), "vote", "left_semi").groupBy("vote", "member").agg(F.max("cast").alias("cast"))
    x, y = v.alias("x"), v.alias("y")
    pairs = x.join(y, (F.col("x.vote") == F.col("y.vote")) & (F.col("x.member") < F.col("y.member")))
    out = pairs.groupBy(F.col("x.member").alias("a"), F.col("y.member").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x.cast") == F.col("y.cast")).alias("same"))
    return out.where(F.col("n") >= least).withColumn("agreement", F.round(F.col("same") / F.col("n"), 6))
