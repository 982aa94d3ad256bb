"""Type hierarchies as edge tables, and type labels as paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgrove.operators.tree import root_path
from eventgrove.plans.ordering import dense_index

# The public event-type hierarchies, one "parent: children" line each.
HIERARCHIES = {
    "ace2005": """
life: be-born marry divorce injure die
movement: transport
transaction: transfer-ownership transfer-money
business: start-org merge-org declare-bankruptcy end-org
conflict: attack demonstrate
contact: meet phone-write
personnel: start-position end-position nominate elect
justice: arrest-jail release-parole trial-hearing charge-indict sue convict sentence fine execute extradite acquit appeal pardon
""",
    "maven": """
Event: Sentiment Scenario Change Possession Action
Sentiment: Agree_or_refuse_to_act Deciding Change_sentiment Suspicion Coming_to_believe Suasion GiveUp Helping Protest Rewards_and_punishments Risk Quarreling Warning Surrendering Aiming Request Commitment Labeling Revenge
Agree_or_refuse_to_act: Ratification Sign_agreement
Change_sentiment: Convincing
Helping: Assistance Supporting Collaboration Rescuing
Rewards_and_punishments: Award
Request: Imposing_obligation
Scenario: Emergency Incident Rite Catastrophe Competition Lighting Confronting_problem Resolve_problem Process_end Process_start Achieve
Change: Influence Being_in_operation Openness Forming_relationships Becoming Change_event_time Cause_change_of_strength Cause_to_be_included Change_tool Cause_to_make_progress Cause_change_of_position_on_a_scale AlterBadState Change_of_leadership Cause_to_amalgamate Dispersal Coming_to_be GetReady Reforming_a_system
Influence: Having_or_lacking_access Causation Preventing_or_letting Control Limiting
Having_or_lacking_access: Hindering
Control: Conquering
Cause_change_of_strength: Recovering
Recovering: Cure
Cause_to_be_included: Becoming_a_member Participation
Becoming_a_member: Employment
Cause_change_of_position_on_a_scale: Expansion
AlterBadState: Bodily_harm Damaging Death
Damaging: Destroying
Coming_to_be: Presence
Possession: Getting Giving Sending Bringing Renting Earnings_and_losses Expensiveness Carry_goods Exchange Cost
Getting: Receiving Commerce_buy
Giving: Submitting_documents Supply Commerce_pay Commerce_sell
Action: Hold Practice Using CauseToBeHidden Communication Come_together Name_conferral Violence Legality Wearing Institutionalization Creating Motion Know Spatial Education_teaching Choosing Arranging Preserving
Using: Use_firearm Expend_resource
CauseToBeHidden: Removing Hiding_objects
Communication: Telling Expressing_publicly Reporting Adducing Response
Expressing_publicly: Statement
Reporting: Reveal_secret
Come_together: Social_event
Violence: Surrounding Attack Military_operation Terrorism Bearing_arms Defending Killing
Surrounding: Besieging
Military_operation: Hostile_encounter
Legality: Justifying Legal_rulings Criminal_investigation Committing_crime Judgment_communication
Legal_rulings: Prison Extradition Releasing Arrest
Committing_crime: Theft Robbery Kidnapping
Creating: Create_artwork Manufacturing Building Recording
Create_artwork: Writing Publishing
Motion: Motion_directional Body_movement Self_motion Patrolling Traveling
Body_movement: Ingestion Breathing Vocalizations
Self_motion: Escaping
Traveling: Arriving Departing Temporary_stay
Know: Perception_active Check Finding Research Scrutiny Scouring Testing
Spatial: Emptying Filling Placing Connect Containing
""",
}


def hierarchy_edges(spark: SparkSession) -> DataFrame:
    """(dataset, parent, child, ord) of the built-in hierarchies."""
    lines = [(name, line) for name, text in HIERARCHIES.items() for line in text.strip().splitlines()]
    table = spark.createDataFrame(lines, "dataset string, line string")
    return table.select(
        "dataset",
        F.substring_index("line", ": ", 1).alias("parent"),
        F.posexplode(F.split(F.substring_index("line", ": ", -1), " ")).alias("ord", "child"),
    ).select("dataset", "parent", "child", "ord")


def parents_of(edges: DataFrame) -> DataFrame:
    """(dataset, child, parents), the parents in text order."""
    return edges.groupBy("dataset", "child").agg(F.sort_array(F.collect_set("parent")).alias("parents"))


def label_parts(label: Column, dataset: str) -> Column:
    """Path of a separated label; only trailing ``n/a`` parts are dropped."""
    if dataset == "ace2005":
        return F.split(label, ":")
    if dataset == "rams":
        return F.split(F.regexp_replace(label, r"(\.n/a)+$", ""), r"\.")
    raise ValueError(f"labels of {dataset!r} are not separated; use hierarchy_paths")


def hierarchy_paths(edges: DataFrame) -> DataFrame:
    """(label, path) for every type of one hierarchy: its ancestors below the root, then itself.

    Of several parents the first counts.
    """
    first = edges.groupBy("child").agg(F.min_by("parent", F.struct("ord", "parent")).alias("parent"))
    names = edges.select("parent").union(edges.select("child")).distinct().toDF("name")
    ids = dense_index(names, [F.col("name")], "id")
    numbered = (
        names.withColumnRenamed("name", "child")
        .join(first, "child", "left")
        .join(ids.select(F.col("name").alias("child"), F.col("id").alias("c")), "child")
        .join(ids.select(F.col("name").alias("parent"), F.col("id").alias("p")), "parent", "left")
        .select(F.col("c").alias("child"), F.col("p").alias("parent"))
    )
    paths = root_path(numbered).select("node", F.posexplode("path").alias("at", "id"))
    named = paths.join(ids, "id").where("at > 0")
    ordered = F.array_sort(F.collect_list(F.struct("at", "name")))
    return (
        named.groupBy("node").agg(F.transform(ordered, lambda s: s["name"]).alias("path"))
        .join(ids, F.col("node") == F.col("id"))
        .select(F.col("name").alias("label"), "path")
    )


def split_label(df: DataFrame, label: str, dataset: str, edges: DataFrame | None = None) -> DataFrame:
    """Adds ``path``; ``edges`` is the hierarchy for datasets whose labels carry no path."""
    if edges is None:
        return df.withColumn("path", label_parts(F.col(label), dataset))
    return df.join(hierarchy_paths(edges).withColumnRenamed("label", label), label, "left")
