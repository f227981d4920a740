"""Clustering of a library's faces into people: a plan that writes nothing, and the job that builds from it.

Everything that grows with faces runs as joins, groups and block kernels: near pairs by library, components, cuts by
diameter, representative vectors, votes and scores. What is left, one row a cluster that matches a person, is decided in
order, as each choice of a person bears on later ones; that is one group a library. Clusters that match nobody are not in it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumen.operators import people as P
from albumen.operators.graph import materialise


def candidates(faces: DataFrame, versions: tuple[str, ...] = (), reassign_confirmed: bool = True, one_size: bool = False) -> DataFrame:
    """The faces that may be clustered: clusterable, with a vector of a version that fits. With `one_size`, vectors of
    another size than that of the library's first face are left out; without `reassign_confirmed`, confirmed faces
    that have a person are."""
    fit = F.col("embedding_version").isin(*versions) if versions else F.lit(True)
    rows = faces.where(P.clusterable() & fit & (F.size("embedding") > 0))
    if one_size:
        first = rows.groupBy("library_id").agg(F.min_by(F.size("embedding"), "face_id").alias("__size"))
        rows = rows.join(first, "library_id").where(F.size("embedding") == F.col("__size")).drop("__size")
    if not reassign_confirmed:
        rows = rows.where(~((F.coalesce("person_id", F.lit("")) != "") & F.coalesce("confirmed", F.lit(False))))
    return rows


def clusters(rows: DataFrame, eps: float, widest: float, min_samples: int = 2) -> DataFrame:
    """(library_id, face_id, part, rank) of candidate faces: clusters by density, cut by diameter; part is the smallest
    face of a cut, rank the order in which clusters are decided: dense ones before single faces, then by first face."""
    found = P.dbscan(rows, "face_id", "embedding", eps, min_samples, by="library_id")
    cut = materialise(P.refine(found, rows, "face_id", "embedding", min(eps, widest)), "parts")
    sizes = cut.groupBy("cluster").agg((F.count("*") == 1).cast("int").alias("single"), F.min("face_id").alias("first"))
    cut = cut.join(sizes, "cluster").join(rows.select("face_id", "library_id"), "face_id")
    return cut.select("library_id", "face_id", "part", F.struct("single", "first", "part").alias("rank"))


def _matches(parts: DataFrame, reps: DataFrame, active: DataFrame, known: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(part, person_id): the person that most of a cluster's faces are listed by and that is alike enough; else the one
    most alike, if by the threshold and the margin. known: library_id, person_id, rep."""
    side = reps.join(parts.select("part", "library_id").distinct(), "part")
    length = F.sqrt(F.aggregate("rep", F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    people = materialise(known.select("library_id", "person_id", F.col("rep").alias("person_rep"), length.alias("length")), "lengths")
    pair = side.join(people, "library_id").where(F.size("rep") == F.size("person_rep"))
    dot = F.aggregate(F.zip_with("rep", "person_rep", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    pair = materialise(pair.select("part", "person_id", (dot / F.col("length")).alias("score")), "scores")
    votes = parts.join(active.select("face_id", "person_id"), "face_id").groupBy("part", "person_id").agg(F.count("*").alias("votes"))
    voted = votes.join(pair, ["part", "person_id"]).where(F.col("score") >= threshold)
    voted = voted.groupBy("part").agg(F.max_by("person_id", F.struct("votes", "score", "person_id")).alias("voted"))
    alike = P.best_match(pair, "part", threshold, margin).where("accepted").select("part", F.col("person_id").alias("alike"))
    return voted.join(alike, "part", "full_outer").select("part", F.coalesce("voted", "alike").alias("person_id"))


def _unit(v) -> np.ndarray:
    v = np.asarray(v, float)
    return v / (np.linalg.norm(v) + 1e-12)


def _decide(threshold: float):
    """Clusters in order take the person they match, or become one. A person is taken again only by clusters that share
    a face with it; a cluster that is unlike what its person has gathered becomes a person of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gathered: dict = {}
        out = []
        for part, person, shares, rep, weight in pdf.sort_values(["single", "first", "part"])[["part", "person_id", "shares", "rep", "weight"]].itertuples(index=False):
            person = person if isinstance(person, str) else None
            if person in gathered and not shares:
                person = None
            old = gathered.get(person)
            if old is not None and len(old) == len(rep) and float(_unit(old) @ _unit(rep)) < threshold:
                person = None
            who = person or f"person-{part}"
            v = np.asarray(rep, float) * weight
            gathered[who] = v if old is None or person is None or len(old) != len(v) else old + v
            out.append((pdf["library_id"].iloc[0], part, who, person is None))
        return pd.DataFrame(out, columns=["library_id", "part", "person_id", "created"])

    return run


def recluster_plan(faces: DataFrame, people: DataFrame, preset: str = "balanced", versions: tuple[str, ...] = (), reassign_confirmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(assignments, planned): (library_id, face_id, person_id, created) of every candidate face, and (library_id,
    person_id, name, face_ids, rep) of the people that a plan keeps or makes. Nothing is written, and confirmed faces
    are left where they are.

    faces: library_id, face_id, embedding, person_id, confidence, confirmed, rejected, review. people: library_id,
    person_id, name, face_ids. A planned person's list is its active faces, in order, and then its clusters'. New people
    are called person-<first face>, and have no name: maintenance.numbered gives them one.
    """
    eps, widest, threshold, margin, *_ = P.PRESETS[preset]
    return _build(candidates(faces, versions, reassign_confirmed, True), faces, people, eps, widest, threshold, margin)


def _build(rows: DataFrame, faces: DataFrame, people: DataFrame, eps: float, widest: float, threshold: float, margin: float) -> tuple[DataFrame, DataFrame]:
    rows = materialise(rows, "candidates")
    parts = materialise(clusters(rows, eps, widest), "clusters")
    weighed = rows.join(parts.select("face_id", "part"), "face_id")
    reps = materialise(P.representatives(weighed, "part"), "reps")
    listed = people.select("library_id", "person_id", F.posexplode("face_ids").alias("pos", "face_id"))
    active = materialise(listed.join(faces.where(~P.rejected()).select("library_id", "person_id", "face_id", "embedding", "confidence", "confirmed", "rejected", "review"), ["library_id", "person_id", "face_id"]), "active")
    known = materialise(P.representatives(active).join(people.select("library_id", "person_id"), "person_id"), "known")
    match = materialise(_matches(parts, reps, active, known, threshold, margin), "matches")
    owner = active.select("face_id", F.col("person_id").alias("owner"))
    one = parts.join(match, "part", "left").join(owner, "face_id", "left")
    one = one.groupBy("library_id", "part", "rank", "person_id").agg(F.bool_or(F.coalesce(F.col("owner") == F.col("person_id"), F.lit(False))).alias("shares"), F.count("*").cast("double").alias("weight"))
    one = one.join(reps, "part").select("library_id", "part", "person_id", "shares", "weight", "rep", "rank.single", "rank.first")
    kind = faces.schema["library_id"].dataType.simpleString()
    # A cluster that matches nobody becomes a person of its own, whatever the others do. It is decided with them only if
    # they may match somebody of its new name (from a plan before).
    one = materialise(one.withColumn("own", F.concat(F.lit("person-"), "part")), "chosen")
    taken = one.where("person_id is not null").select("library_id", F.col("person_id").alias("own")).distinct()
    alone = one.where("person_id is null").join(taken, ["library_id", "own"], "left_anti").select("library_id", "part", F.col("own").alias("person_id"), F.lit(True).alias("created"))
    met = one.where("person_id is not null").unionByName(one.where("person_id is null").join(taken, ["library_id", "own"], "left_semi").select(*one.columns)).drop("own")
    met = met.groupBy("library_id").applyInPandas(_decide(threshold), f"library_id {kind}, part string, person_id string, created boolean")
    decided = materialise(alone.unionByName(met), "decided")
    assignments = materialise(parts.join(decided, ["library_id", "part"]).select("library_id", "face_id", "person_id", "created"), "assignments")
    # Lists: active faces of people who were chosen, in their order, then the faces of their clusters.
    chosen = assignments.groupBy("library_id", "person_id").agg(F.bool_and("created").alias("created"))
    before = active.join(chosen, ["library_id", "person_id"], "left_semi").select("library_id", "person_id", "face_id", F.struct(F.lit(0).alias("k"), F.col("pos").cast("string").alias("at")).alias("at"))
    after = assignments.select("library_id", "person_id", "face_id", F.struct(F.lit(1).alias("k"), F.col("face_id").alias("at")).alias("at"))
    lists = before.unionByName(after).groupBy("library_id", "person_id", "face_id").agg(F.min(F.struct("at.k", F.when(F.col("at.k") == 0, F.lpad("at.at", 12, "0")).otherwise(F.col("at.at")).alias("at"))).alias("at"))
    lists = lists.groupBy("library_id", "person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "face_id"))), lambda x: x["face_id"]).alias("face_ids"))
    lists = materialise(lists, "lists")
    gathered = lists.select("library_id", "person_id", F.explode("face_ids").alias("face_id")).join(rows.drop("person_id", "library_id"), "face_id")
    rep = P.representatives(gathered)
    names = people.select("library_id", "person_id", "name")
    planned = lists.join(names, ["library_id", "person_id"], "left").join(rep, "person_id", "left")
    return assignments, planned.select("library_id", "person_id", F.coalesce("name", F.lit("")).alias("name"), "face_ids", F.coalesce("rep", F.array().cast("array<double>")).alias("rep"))


def cluster_job(faces: DataFrame, people: DataFrame, preset: str = "balanced", versions: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(people, faces, problems) after clustering all candidate faces anew, confirmed ones too: `people` are those that
    clusters matched or made, `faces` have their owners, and `problems` (face_id, what) is empty unless a candidate is
    without an owner or has two."""
    from albumen.operators.maintenance import incomplete

    eps, widest, threshold, margin, *_ = P.PRESETS[preset]
    rows = candidates(faces, versions)
    assignments, planned = _build(rows, faces, people, eps, widest, threshold, margin)
    new = assignments.select("library_id", "face_id", F.col("person_id").alias("__to"))
    owned = faces.join(new, ["library_id", "face_id"], "left").withColumn("person_id", F.coalesce("__to", "person_id"))
    return planned, owned.select(*faces.columns), incomplete(rows, assignments)
