"""The thirty exercises with results worked out by hand."""

from pyspark.sql import functions as F

from tessella.operators import graph as g

NAME, LABEL = "foaf:name", "rdfs:label"


def rows(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


def people(t, cls="Person"):
    return g.of_class(g.pattern(t, NAME, "x", "name"), t, "x", cls)


def english(t, var, out="label"):
    return g.pattern(t, LABEL, var, out, lang="en")


def test_01_people_with_names(campus):
    got = rows(people(campus).orderBy("name"), "name")
    assert got == ["Alice", "Anna Meyer", "Bob", "Claire Dubois", "Clara", "Dina", "Eva", "Faris", "Gina", "Hassan", "Iris", "Jonas", "Lukas Schmidt"]


def test_02_cities_by_population(campus):
    df = g.star(g.instances(campus, "City", "c"), campus, "c", {"population": "n"}).join(english(campus, "c"), ["c"])
    got = rows(df.orderBy(F.desc(g.as_int(F.col("n")))), "label", "n")
    assert got == [("Berlin", "3850000"), ("Paris", "2100000"), ("Hamburg", "1900000"), ("Munich", "1480000"), ("Hildesheim", "103000")]


def test_03_classes(campus):
    got = dict(rows(g.class_counts(campus), "type", "count"))
    assert got == {
        "rdfs:Class": 11, "Person": 13, "Student": 10, "Professor": 3, "City": 5, "University": 3,
        "Course": 5, "Book": 4, "Company": 3, "Project": 3, "Event": 3, "Movie": 3,
    }


def test_04_course_credits(campus):
    df = g.star(g.instances(campus, "Course", "c"), campus, "c", {"credits": "n"}).join(english(campus, "c"), ["c"])
    assert rows(df.orderBy("label"), "label", "n") == [
        ("Advanced SPARQL", "6"), ("Databases", "4"), ("Intro to AI", "5"), ("Knowledge Graphs", "5"), ("SPARQL Basics", "5"),
    ]


def test_05_books_by_price(campus):
    df = g.wide(campus, "b", {NAME: "name", "price": "price"})
    assert rows(df.orderBy(g.as_decimal(F.col("price"))), "name") == ["RDF in Practice", "Learning Graphs", "Mastering SPARQL", "AI Foundations"]


def test_06_students_in_berlin(campus):
    df = people(campus, "Student").join(g.pattern(campus, "livesIn", "x", None, obj="Berlin"), ["x"])
    assert rows(df.orderBy("name"), "name") == ["Bob", "Eva", "Hassan"]


def test_07_name_or_label(campus):
    either = g.union(g.pattern(campus, NAME, "x", "name"), g.pattern(campus, LABEL, "x", "name"))
    got = rows(g.of_class(either, campus, "x", "Person"), "name")
    assert len(got) == 18 and {"Alice", "Alice A.", "Gina G."} <= set(got)


def test_08_optional_mail(campus):
    got = dict(rows(g.optional(people(campus, "Student"), g.pattern(campus, "email", "x", "mail"), "x"), "name", "mail"))
    assert len(got) == 10 and got["Bob"] == "bob@example.org"
    assert [n for n, m in sorted(got.items()) if m is None] == ["Clara", "Eva", "Gina", "Iris", "Jonas"]


def test_09_enrolled(campus):
    df = people(campus, "Student").join(g.pattern(campus, "enrolledIn", "x", None, obj="SPARQL101"), ["x"])
    assert rows(df.orderBy("name"), "name") == ["Alice", "Bob", "Eva", "Gina"]


def test_10_books_alice_likes(campus):
    df = g.path(g.pattern(campus, "likesBook", None, "b", subject="Alice"), campus, "b", [(NAME, "name")])
    assert rows(df.orderBy("name"), "name") == ["Learning Graphs", "Mastering SPARQL"]


def test_11_knows_someone(campus):
    df = people(campus).join(g.pattern(campus, "knows", "x", "y"), ["x"]).select("x", "name").distinct()
    assert df.count() == 10


def test_12_gpa_below_two(campus):
    df = people(campus, "Student").join(g.pattern(campus, "gpa", "x", "gpa"), ["x"]).filter(g.as_decimal(F.col("gpa")) < 2)
    assert rows(df.orderBy("gpa"), "name", "gpa") == [("Clara", "1.3"), ("Iris", "1.4"), ("Faris", "1.5"), ("Alice", "1.7"), ("Gina", "1.8"), ("Dina", "1.9")]


def test_13_german_labels(campus):
    got = rows(g.pattern(campus, LABEL, "x", "label", lang="de").orderBy("label"), "label")
    assert got == [
        "Berlin", "Fortgeschrittenes SPARQL", "Hamburg", "Hildesheim", "Lernende Graphen", "München",
        "Projekt Atlas", "SPARQL Grundlagen", "SPARQL meistern", "Wissensgraphen",
    ]


def test_14_rating(campus):
    df = people(campus, "Movie").join(g.pattern(campus, "rating", "x", "r"), ["x"]).filter(g.as_decimal(F.col("r")) > 7.5)
    assert rows(df, "name") == ["The Graph Mystery"]


def test_15_active_or_planned(campus):
    df = g.pattern(campus, "status", "p", "status", obj=["active", "planned"]).join(english(campus, "p"), ["p"])
    assert rows(df.orderBy("status", "label"), "label") == ["Project Atlas", "Project Nova"]


def test_16_students_per_city(campus):
    df = g.of_class(g.pattern(campus, "livesIn", "x", "c"), campus, "x", "Student").join(english(campus, "c"), ["c"])
    assert dict(rows(g.count_per(df, "label", "x"), "label", "n")) == {"Berlin": 3, "Hamburg": 2, "Hildesheim": 2, "Munich": 2, "Paris": 1}


def test_17_attendance(campus):
    df = g.pattern(campus, "attends", "x", "e").join(english(campus, "e"), ["e"])
    assert dict(rows(g.count_per(df, "label", "x"), "label", "n")) == {"Hack Day 2025": 4, "KG Summit 2025": 4, "Data Weekend 2024": 4}


def test_18_both_skills(campus):
    both = g.with_all_values(campus, "hasSkill", ["Python", "SPARQL"], "x")
    assert rows(people(campus, "Student").join(both, ["x"], "left_semi").orderBy("name"), "name") == ["Faris", "Iris"]


def test_19_intern_or_part_time(campus):
    either = g.union(g.pattern(campus, "internsAt", "x", None), g.pattern(campus, "worksPartTimeAt", "x", None))
    assert rows(people(campus).join(either, ["x"]).orderBy("name"), "name") == ["Alice", "Bob", "Dina", "Faris", "Iris"]


def test_20_advisors(campus):
    df = g.path(people(campus, "Professor"), campus, "x", [("advisorOf", "p")]).join(english(campus, "p"), ["p"])
    assert rows(df.orderBy("name"), "name", "label") == [("Anna Meyer", "Project Atlas"), ("Claire Dubois", "Project Echo"), ("Lukas Schmidt", "Project Nova")]


def test_21_readers_of_a_topic(campus):
    books = g.of_class(g.pattern(campus, "likesBook", "x", "b"), campus, "b", "Book").join(g.pattern(campus, "topic", "b", None, obj="sparql"), ["b"])
    assert rows(people(campus, "Student").join(books, ["x"]).orderBy("name"), "name") == ["Alice", "Eva", "Faris", "Gina", "Iris"]


def test_22_events_of_2025(campus):
    df = english(campus, "e").join(g.wide(campus, "e", {"startDate": "a", "endDate": "b"}), ["e"])
    df = df.filter(g.as_date(F.col("a")).between("2025-01-01", "2025-12-31")).orderBy("a")
    assert rows(df, "label", "b") == [("Hack Day 2025", "2025-05-04"), ("KG Summit 2025", "2025-09-14")]


def test_23_names_from_a_or_b(campus):
    df = g.pattern(campus, NAME, "x", "name").filter(F.col("name").rlike("^(A|B)"))
    assert rows(df.orderBy("name"), "name") == ["AI Foundations", "Alice", "Anna Meyer", "Bob"]


def test_24_friends_elsewhere(campus):
    students = g.star(people(campus, "Student"), campus, "x", {"livesIn": "c1", "knows": "y"})
    friends = g.star(g.pattern(campus, NAME, "y", "friend"), campus, "y", {"livesIn": "c2"})
    got = rows(students.join(friends, ["y"]).filter("c1 != c2").select("name", "friend").distinct().orderBy("name", "friend"), "name", "friend")
    assert got == [
        ("Alice", "Bob"), ("Alice", "Clara"), ("Bob", "Alice"), ("Bob", "Dina"), ("Clara", "Alice"), ("Dina", "Bob"), ("Dina", "Eva"),
        ("Eva", "Dina"), ("Faris", "Alice"), ("Faris", "Claire Dubois"), ("Gina", "Alice"), ("Gina", "Bob"), ("Iris", "Faris"), ("Jonas", "Clara"),
    ]


def test_25_courses_per_university(campus):
    df = g.path(g.instances(campus, "Course", "c"), campus, "c", [("taughtAt", "u"), (NAME, "name")])
    assert dict(rows(g.count_per(df, "name", "c"), "name", "n")) == {"University of Hildesheim": 3, "TU Berlin": 1, "LMU Munich": 1}


def test_26_courses_per_student(campus):
    df = g.star(people(campus, "Student"), campus, "x", {"enrolledIn": "c"}).groupBy("name").agg(F.count("c").alias("n"))
    got = rows(df.orderBy(F.desc("n"), "name"), "name", "n")
    assert got[:6] == [("Alice", 2), ("Bob", 2), ("Dina", 2), ("Faris", 2), ("Gina", 2), ("Iris", 2)]
    assert got[6:] == [("Clara", 1), ("Eva", 1), ("Hassan", 1), ("Jonas", 1)]


def test_27_same_film_as_alice(campus):
    df = people(campus, "Student").join(g.sharing_with(campus, "likesMovie", "Alice", "x"), ["x"])
    assert rows(df.orderBy("name"), "name") == ["Dina", "Eva", "Gina"]


def test_28_mean_gpa(campus):
    df = g.star(g.instances(campus, "Student", "x"), campus, "x", {"studiesAt": "u", "gpa": "gpa"})
    df = g.path(df, campus, "u", [(NAME, "name")]).groupBy("name").agg(F.avg(g.as_decimal(F.col("gpa"))).alias("m"))
    got = {n: round(float(m), 4) for n, m in rows(df, "name", "m")}
    assert got == {"LMU Munich": 1.6, "University of Hildesheim": 1.925, "TU Berlin": 2.4}


def test_29_german_and_english(campus):
    df = g.pattern(campus, LABEL, "x", None, lang="de").join(g.pattern(campus, LABEL, "x", None, lang="en"), ["x"], "left_semi")
    assert rows(df.distinct().orderBy("x"), "x") == ["Berlin", "Hamburg", "Hildesheim", "KG101", "Munich", "ProjectAtlas", "SPARQL101", "SPARQL201"]


def test_30_three_oldest(campus):
    df = people(campus).join(g.pattern(campus, "age", "x", "age"), ["x"])
    assert rows(g.top_k(df, 3, g.as_int(F.col("age")).desc()), "name", "age") == [("Lukas Schmidt", "52"), ("Claire Dubois", "49"), ("Anna Meyer", "46")]
