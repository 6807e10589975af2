"""The exercise graph: people, courses, books and events, as fixed values."""

CITIES = {
    "Berlin": ("Berlin", "de", "Berlin", 3850000),
    "Hamburg": ("Hamburg", "de", "Hamburg", 1900000),
    "Munich": ("München", "de", "Munich", 1480000),
    "Hildesheim": ("Hildesheim", "de", "Hildesheim", 103000),
    "Paris": ("Paris", "fr", "Paris", 2100000),
}
UNIVERSITIES = {"UniHildesheim": "University of Hildesheim", "TUberlin": "TU Berlin", "LMU": "LMU Munich"}
COURSES = {
    "SPARQL101": ("SPARQL Basics", 5, "UniHildesheim"),
    "SPARQL201": ("Advanced SPARQL", 6, "UniHildesheim"),
    "KG101": ("Knowledge Graphs", 5, "TUberlin"),
    "DB101": ("Databases", 4, "UniHildesheim"),
    "AI101": ("Intro to AI", 5, "LMU"),
}
PROJECTS = {"ProjectAtlas": ("Project Atlas", "active"), "ProjectNova": ("Project Nova", "planned"), "ProjectEcho": ("Project Echo", "completed")}
EVENTS = {
    "HackDay2025": ("Hack Day 2025", "2025-05-03", "2025-05-04"),
    "KGSummit2025": ("KG Summit 2025", "2025-09-12", "2025-09-14"),
    "DataWeekend2024": ("Data Weekend 2024", "2024-11-16", "2024-11-17"),
}
BOOKS = {
    "BookGraphs": ("Learning Graphs", "39.99", "graphs"),
    "BookSPARQL": ("Mastering SPARQL", "44.50", "sparql"),
    "BookRDF": ("RDF in Practice", "35.00", "rdf"),
    "BookAI": ("AI Foundations", "49.00", "ai"),
}
MOVIES = {"MovieGraph": ("The Graph Mystery", "8.1"), "MovieData": ("Data Dreams", "7.4"), "MovieSemantic": ("Semantic Hearts", "6.9")}
COMPANIES = ("GraphSoft", "DataForge", "SemanticWorks")
PROFESSORS = {
    "ProfMeyer": ("Anna Meyer", 46, "Hildesheim", "SPARQL|RDF|Knowledge Graphs", "ProjectAtlas"),
    "ProfSchmidt": ("Lukas Schmidt", 52, "Berlin", "OWL|SHACL|Linked Data", "ProjectNova"),
    "ProfDubois": ("Claire Dubois", 49, "Munich", "AI|Machine Learning", "ProjectEcho"),
}
# age, city, university, courses, gpa, skills, knows, books, movies, events, has e-mail, own label
STUDENTS = {
    "Alice": (22, "Hildesheim", "UniHildesheim", "SPARQL101|DB101", "1.7", "Python|SQL", "Bob|Clara", "BookSPARQL|BookGraphs", "MovieGraph", "HackDay2025", True, "Alice A."),
    "Bob": (24, "Berlin", "TUberlin", "KG101|SPARQL101", "2.1", "Java|SPARQL", "Alice|Dina", "BookRDF", "MovieData", "HackDay2025|DataWeekend2024", True, "Bob B."),
    "Clara": (21, "Hamburg", "UniHildesheim", "DB101", "1.3", "R|Statistics", "Alice", "BookGraphs", "MovieSemantic", "DataWeekend2024", False, "Clara C."),
    "Dina": (23, "Munich", "LMU", "AI101|KG101", "1.9", "Python|Machine Learning", "Bob|Eva", "BookAI", "MovieData|MovieGraph", "KGSummit2025", True, None),
    "Eva": (20, "Berlin", "TUberlin", "SPARQL101", "2.4", "HTML|CSS", "Dina", "BookSPARQL", "MovieGraph", "HackDay2025", False, "Eva E."),
    "Faris": (26, "Paris", "LMU", "AI101|SPARQL201", "1.5", "Python|SPARQL|RDF", "Alice|ProfDubois", "BookSPARQL|BookRDF", "MovieData", "KGSummit2025", True, None),
    "Gina": (22, "Hamburg", "UniHildesheim", "SPARQL101|SPARQL201", "1.8", "SPARQL|Linked Data", "Alice|Bob", "BookGraphs|BookSPARQL", "MovieGraph|MovieSemantic", "HackDay2025|KGSummit2025", False, "Gina G."),
    "Hassan": (25, "Berlin", "TUberlin", "KG101", "2.7", "JavaScript", "Eva", "BookAI", "", "DataWeekend2024", True, None),
    "Iris": (23, "Munich", "LMU", "AI101|SPARQL201", "1.4", "Python|AI|SPARQL", "Dina|Faris", "BookAI|BookSPARQL", "MovieData", "KGSummit2025", False, None),
    "Jonas": (21, "Hildesheim", "UniHildesheim", "DB101", "2.9", "SQL", "Clara", "BookRDF", "", "DataWeekend2024", False, None),
}
INTERNS = {"Alice": "GraphSoft", "Dina": "SemanticWorks", "Faris": "DataForge"}
PART_TIME = {"Bob": "GraphSoft", "Iris": "SemanticWorks"}
GERMAN_LABELS = {
    "SPARQL101": "SPARQL Grundlagen", "SPARQL201": "Fortgeschrittenes SPARQL", "KG101": "Wissensgraphen",
    "BookGraphs": "Lernende Graphen", "BookSPARQL": "SPARQL meistern", "ProjectAtlas": "Projekt Atlas",
}


def triples():
    """Rows ``s, p, o, o_kind, dtype, lang`` of the whole graph."""
    rows = []

    def iri(s, p, *objects):
        rows.extend((s, p, o, "iri", None, None) for o in objects if o)

    def lit(s, p, *values, lang=None, dtype="xsd:string"):
        rows.extend((s, p, str(v), "literal", None if lang else dtype, lang) for v in values)

    for k, (local, lang, en, people) in CITIES.items():
        iri(k, "rdf:type", "City")
        lit(k, "rdfs:label", local, lang=lang)
        lit(k, "rdfs:label", en, lang="en")
        lit(k, "population", people, dtype="xsd:integer")
    for k, name in UNIVERSITIES.items():
        iri(k, "rdf:type", "University")
        lit(k, "foaf:name", name)
    for k, (label, credits, at) in COURSES.items():
        iri(k, "rdf:type", "Course")
        lit(k, "rdfs:label", label, lang="en")
        lit(k, "credits", credits, dtype="xsd:integer")
        iri(k, "taughtAt", at)
    for k, (label, status) in PROJECTS.items():
        iri(k, "rdf:type", "Project")
        lit(k, "rdfs:label", label, lang="en")
        lit(k, "status", status)
    for k, (label, start, end) in EVENTS.items():
        iri(k, "rdf:type", "Event")
        lit(k, "rdfs:label", label, lang="en")
        lit(k, "startDate", start, dtype="xsd:date")
        lit(k, "endDate", end, dtype="xsd:date")
    for k, (name, price, topic) in BOOKS.items():
        iri(k, "rdf:type", "Book")
        lit(k, "foaf:name", name)
        lit(k, "price", price, dtype="xsd:decimal")
        lit(k, "topic", topic)
    for k, (name, rating) in MOVIES.items():
        iri(k, "rdf:type", "Movie")
        lit(k, "foaf:name", name)
        lit(k, "rating", rating, dtype="xsd:decimal")
    for k in COMPANIES:
        iri(k, "rdf:type", "Company")
        lit(k, "foaf:name", k)
    for k, (name, age, city, skills, project) in PROFESSORS.items():
        iri(k, "rdf:type", "Professor", "Person")
        lit(k, "foaf:name", name)
        lit(k, "age", age, dtype="xsd:integer")
        iri(k, "livesIn", city)
        lit(k, "hasSkill", *skills.split("|"))
        iri(k, "advisorOf", project)
    for k, (age, city, uni, courses, gpa, skills, knows, books, movies, events, mail, label) in STUDENTS.items():
        iri(k, "rdf:type", "Student", "Person")
        lit(k, "foaf:name", k)
        lit(k, "age", age, dtype="xsd:integer")
        iri(k, "livesIn", city)
        iri(k, "studiesAt", uni)
        lit(k, "gpa", gpa, dtype="xsd:decimal")
        lit(k, "hasSkill", *skills.split("|"))
        for p, objects in (("enrolledIn", courses), ("knows", knows), ("likesBook", books), ("likesMovie", movies), ("attends", events)):
            iri(k, p, *objects.split("|"))
        if mail:
            lit(k, "email", f"{k.lower()}@example.org")
        if label:
            lit(k, "rdfs:label", label, lang="en")
    for k, company in INTERNS.items():
        iri(k, "internsAt", company)
    for k, company in PART_TIME.items():
        iri(k, "worksPartTimeAt", company)
    for k, label in GERMAN_LABELS.items():
        lit(k, "rdfs:label", label, lang="de")
    for c in "Person Student Professor City University Course Book Company Project Event Movie".split():
        iri(c, "rdf:type", "rdfs:Class")
    return rows
