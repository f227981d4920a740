"""Merges, splits, confirmations and suppression on tables worked out by hand."""

from albumen.operators import maintenance


def faces_df(spark, rows):
    """face_id, person_id, confidence, confirmed, rejected, review; boxes pass the gate from a confidence of 0.32 on."""
    return spark.createDataFrame([(*r, 90, 90, 100, 100) for r in rows], "face_id string, person_id string, confidence double, confirmed boolean, rejected boolean, review string, width int, height int, image_width int, image_height int")


def people_df(spark, rows):
    return spark.createDataFrame(rows, "person_id string, name string, face_ids array<string>")


def lists(people):
    return {r.person_id: (r.name, r.face_ids) for r in people.collect()}


def states(faces):
    return {r.face_id: (r.person_id, r.confirmed, r.rejected, r.review, r.confidence) for r in faces.collect()}


def test_merge(spark):
    people = people_df(spark, [("a", "Unnamed 3", ["f1"]), ("b", "unnamed", ["f2", "f3", "gone", "f6"]), ("c", " Ann ", ["f4", "f2"]), ("d", "Bo", ["f5", "f5", "f6"]), ("e", "Cy", ["f7"]), ("g", "Di", [])])
    rows = [("f1", "a", 0.5, False, False, ""), ("f2", "b", 0.4, False, False, "suspicious"), ("f3", "b", 0.9, False, True, "rejected"), ("f4", "e", 1.5, False, False, ""), ("f5", "d", 0.9, False, False, ""), ("f6", "d", None, None, None, None), ("f7", "e", 0.7, False, False, "")]
    faces = faces_df(spark, rows)
    merged, moved, undo = maintenance.merge_people(people, faces, "a", ["b", "c", "missing"])
    assert lists(merged) == {"a": ("Ann", ["f1", "f2", "f6", "f4"]), "d": ("Bo", ["f5", "f5"]), "e": ("Cy", ["f7"]), "g": ("Di", [])}
    got = states(moved)
    assert got["f2"] == ("a", True, False, "confirmed", 1.0) and got["f4"] == ("a", True, False, "confirmed", 1.5) and got["f6"] == ("a", True, False, "confirmed", 1.0)
    assert {k: got[k] for k in ("f1", "f3", "f5", "f7")} == {k: states(faces)[k] for k in ("f1", "f3", "f5", "f7")}
    assert lists(undo) == {k: v for k, v in lists(people).items() if k in "abc"}
    # A named base keeps its name, a blank one too; without a base nothing happens.
    assert lists(maintenance.merge_people(people, faces, "d", ["c"])[0])["d"][0] == "Bo"
    same, kept, _ = maintenance.merge_people(people, faces, "zz", ["b"])
    assert lists(same) == lists(people) and states(kept) == states(faces)
    # A person whose only face was listed by the merged one too goes with it.
    gone, _, _ = maintenance.merge_people(people_df(spark, [("a", "A", []), ("b", "B", ["x"]), ("c", "C", ["x"])]), faces_df(spark, [("x", "c", 0.9, False, False, "")]), "a", ["b"])
    assert lists(gone) == {"a": ("A", ["x"])}


def test_split(spark):
    people = people_df(spark, [("a", "Ann", ["f1", "f2", "f3"]), ("b", "Unnamed 41", ["f2"]), ("c", "Cy", ["f4"])])
    faces = faces_df(spark, [("f1", "a", 0.9, False, False, ""), ("f2", "a", 0.3, False, False, "suspicious"), ("f3", "c", 0.9, False, False, ""), ("f4", "c", 0.9, False, False, "")])
    ids = spark.createDataFrame([("f2",), ("f3",), ("f9",)], "face_id string")
    split, moved = maintenance.split_person(people, faces, "a", ids, "new")
    assert lists(split) == {"a": ("Ann", ["f1", "f3"]), "c": ("Cy", ["f4"]), "new": ("Unnamed 42", ["f2"])}
    assert states(moved)["f2"] == ("new", True, False, "confirmed", 1.0) and states(moved)["f3"] == states(faces)["f3"]
    # The last face takes its person along; what the person does not own is no split.
    whole, _ = maintenance.split_person(people, faces, "c", spark.createDataFrame([("f4",)], "face_id string"), "new")
    assert lists(whole)["new"] == ("Unnamed 42", ["f4"]) and "c" not in lists(whole)
    none, same = maintenance.split_person(people, faces, "a", spark.createDataFrame([("f3",)], "face_id string"), "new")
    assert lists(none) == lists(people) and states(same) == states(faces)


def test_confirm_and_label(spark):
    people = people_df(spark, [("a", "Ann", ["f1"]), ("b", "Bo", ["f2"]), ("c", "Cy", ["f3", "f4"])])
    faces = faces_df(spark, [("f1", "a", 0.9, False, False, ""), ("f2", "b", 0.9, False, False, ""), ("f3", "c", 0.2, False, False, ""), ("f4", "c", 0.9, False, True, "rejected")])
    ids = spark.createDataFrame([("f2",), ("f3",), ("f4",), ("f9",)], "face_id string")
    got, moved = maintenance.confirm_faces(people, faces, "a", ids)
    assert lists(got) == {"a": ("Ann", ["f1", "f2"])}
    assert {k: v for k, v in states(moved).items() if k != "f1"} == {k: ("a", True, False, "confirmed", 1.0) for k in ("f2", "f3", "f4")}
    same, kept = maintenance.confirm_faces(people, faces, "zz", ids)
    assert lists(same) == lists(people) and states(kept) == states(faces)
    named, sure = maintenance.label_person(people, faces, "c", "Zoe")
    assert lists(named)["c"] == ("Zoe", ["f3", "f4"]) and {k: states(sure)[k] for k in ("f3", "f4")} == {k: ("c", True, False, "confirmed", 1.0) for k in ("f3", "f4")}
    assert states(sure)["f1"] == states(faces)["f1"]


def test_suppression(spark):
    people = people_df(spark, [("a", "Ann", ["f1", "f2", "f3"]), ("b", "Unnamed 1", ["f4"]), ("c", "Unnamed 2", ["f5"]), ("d", "Dan", ["f6"]), ("e", "Unnamed", ["f7"])])
    rows = [("f1", "a", 0.5, False, False, ""), ("f2", "a", 0.2, False, False, ""), ("f3", "a", 0.2, True, False, ""), ("f4", "b", 0.5, False, False, ""), ("f5", "c", 0.6, False, False, ""), ("f6", "d", 0.1, False, False, ""), ("f7", "e", 0.1, False, True, ""), ("f8", None, None, None, None, None)]
    got, faces = maintenance.suppress_suspicious(people, faces_df(spark, rows))
    assert lists(got) == {"a": ("Ann", ["f1", "f3"]), "c": ("Unnamed 2", ["f5"]), "d": ("Dan", []), "e": ("Unnamed", ["f7"])}
    assert states(faces) == {
        "f1": (None, False, False, "suspicious", 0.5), "f2": (None, False, True, "rejected", 0.2), "f3": ("a", True, False, "", 0.2), "f4": (None, False, False, "suspicious", 0.5), "f5": ("c", False, False, "", 0.6),
        "f6": (None, False, True, "rejected", 0.1), "f7": ("e", False, True, "", 0.1), "f8": (None, False, True, "rejected", None),
    }


def test_deleted_photos_leave_people_and_jobs(spark):
    names = spark.createDataFrame([("a.jpg",), ("b.jpg",)], "filename string")
    photos = spark.createDataFrame([("a.jpg", ["ann", "bob", "ghost"]), ("b.jpg", []), ("c.jpg", ["ghost", "bob", "ann"]), ("d.jpg", ["other", "ann"]), ("e.jpg", None)], "filename string, people_ids array<string>")
    faces = spark.createDataFrame([("f1", "a.jpg"), ("f2", "c.jpg"), ("f3", "a.jpg")], "face_id string, filename string")
    people = spark.createDataFrame([("ann", ["f2", "f1", "x"]), ("bob", ["f3"]), ("eve", [])], "person_id string, face_ids array<string>")
    left, rest = maintenance.delete_people_of(names, photos, faces, people)
    # Bob had the one face; Eve's list was empty before. Ghost never had a row; nobody asks for other.
    assert {r.person_id: r.face_ids for r in left.collect()} == {"ann": ["f2", "x"], "eve": []}
    assert {r.filename: r.people_ids for r in rest.collect()} == {"c.jpg": ["ann"], "d.jpg": ["other", "ann"], "e.jpg": None}

    values = ["a.jpg", "a.jpg-7", "u1:b.jpg:9", "processing:u1:b.jpg", "processing:u2:a.jpg", "exif:a.jpg", "c.jpg", None]
    jobs = [(f"k{i}{j}{m}", v, w, u, v if j == 1 else None) for i, v in enumerate(values) for j, w in enumerate(["a.jpg", "z", None]) for m, u in enumerate(["u1", "u2", None])]
    jobs = spark.createDataFrame(jobs, "row_key string, job_id string, filename string, user_id string, correlation_id string")
    want = jobs
    for name in ("a.jpg", "b.jpg"):
        want = want.join(maintenance.jobs_of(jobs, "u1", name).select("row_key"), "row_key", "left_anti")
    got = sorted(r.row_key for r in maintenance.delete_jobs_of(names, jobs, "u1").collect())
    assert got == sorted(r.row_key for r in want.collect()) and 0 < len(got) < 72
