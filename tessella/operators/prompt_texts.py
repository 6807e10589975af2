"""Fixed values of the rendered prompts.

The texts, row formats and labels below must equal what users already feed to
their models, character by character, so they are stated as plain text.
``<<LABEL>>``, ``<<TEMPLATE>>`` and ``<<CLASS>>`` are filled per profile.
"""

MANY = "one to many"
ONE = "one to one"
PREDICATE_MANY = "Predicate (multiple)"
PREDICATE = "Predicate"
DEFAULT_CLASS = "C27001"
VERSIONED_NAME = r"\A(.*)_v([0-9]+)\.(?:json|txt)\z"

SCHEMA_HEAD = (
    "\n\n#### Template Properties\n\n"
    "| Concept | ORKG Term | Type | Description & Usage |\n"
    "|---------|-----------|------|---------------------|\n"
)
SCHEMA_ROW = "| %s%s | `orkgp:%s` | %s | %s. Usage: `%s` |\n"
ROW_INDENT = ("", "└─ ", "&nbsp;&nbsp;&nbsp;&nbsp;└─ ")
USAGE = (
    "?variable orkgp:%s ?target",
    "?contribution orkgp:%s ?subtemplate . ?subtemplate orkgp:%s ?subtarget",
    "?contribution orkgp:%s ?subtemplate . ?subtemplate orkgp:%s ?nestedtemplate . "
    "?nestedtemplate orkgp:%s ?nestedtarget",
)

OUTLINE_HEAD = "\n\n#### Template Hierarchy Structure\n\nTraverse via parent → child:\n\n"
OUTLINE_ROW = "%s**%s** (`orkgp:%s`)\n"
OUTLINE_INDENT = ("", "  └─ ", "    └─ ")
OUTLINE_FOOT = "└─ = child of above; traverse parent first.\n\n"

GUIDANCE_HEAD = "\n\n## Template-Specific Guidance\n"
GUIDANCE_PARTS = ("domain_knowledge", "query_examples", "specific_rules", "common_patterns", "troubleshooting")
GUIDANCE_SCHEMA = "template_id string, guidance_label string, " + ", ".join(f"{p} string" for p in GUIDANCE_PARTS)

BASE = """# ORKG SPARQL Generator

Generate precise, executable SPARQL for the Open Research Knowledge Graph. Template: "<<LABEL>>" (ID: <<TEMPLATE>>).

## Prefixes (required in every query)
```sparql
PREFIX orkgr: <http://orkg.org/orkg/resource/>
PREFIX orkgc: <http://orkg.org/orkg/class/>
PREFIX orkgp: <http://orkg.org/orkg/predicate/>
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>
```

## Core
| Entity | Term | Usage |
|--------|------|--------|
| Paper | - | publication resource |
| Contribution | `orkgp:P31`, `orkgc:<<CLASS>>` | `?paper orkgp:P31 ?contribution` ; `?contribution a orkgc:<<CLASS>> .` |
| Year (if time/trends) | `orkgp:P29` | `?paper orkgp:P29 ?year` (never on contribution) |
| Venue (if asked) | `orkgp:P135046` | `?contribution orkgp:P135046 ?venue . ?venue rdfs:label ?venue_name` |"""

RULES = """

## Rules
1. **Class**: Always `?contribution a orkgc:<<CLASS>> .`
2. **Year**: Only if question asks time/trends; use `?paper orkgp:P29 ?year` (never `?contribution orkgp:P29`).
3. **Top N / frequency**: Include `?paper` and `?paperLabel` in SELECT; no LIMIT; ORDER BY paper.
4. **One query per code block**: Each ```sparql block has one SELECT; use `# id: name`.
5. **URIs vs labels**: Properties return URIs. Get label first: `?resource rdfs:label ?label`. Compare only the label to strings.
6. **Label comparison**: Always use `LCASE(STR(?label)) = LCASE("value")` (case-insensitive).
7. **BIND**: Only in WHERE; variables in BIND must be defined before it. No IF() in SELECT—use BIND(IF(...)) in WHERE.
8. **Proportions**: Use subqueries; cast `xsd:decimal` for division.
9. **Nested props**: Follow schema hierarchy (contribution → parent → child); use `└─` in Template Properties.

**Output**: Only SPARQL in ```sparql blocks. No explanations. One query per block.

## Input
**Research Question:** [Research Question]"""

# template_id, label, domain knowledge, examples, rules, patterns, troubleshooting
GUIDANCE = [
    (
        "R186491",
        "Empirical Research Practice",
        """
Empirical study = has data collection (not "no collection"), data analysis (not "no analysis"). Often filter venue = IEEE International Requirements Engineering Conference. Use `?contribution a orkgc:C27001`; return ?dc_label/?da_label and let processing filter.
""",
        "",
        """
Exclude non-empirical: `FILTER(LCASE(STR(?dc_label)) != LCASE("no collection"))`, `FILTER(LCASE(STR(?da_label)) != LCASE("no analysis"))`. Venue: `?contribution orkgp:P135046 ?venue . ?venue rdfs:label ?venue_name` then FILTER with LCASE. Method types: traverse contribution → data collection → method → method type → label. Threats: `?contribution orkgp:P39099 ?threats` then OPTIONAL per threat type. Use SAMPLE()+GROUP BY for boolean/dedup.
""",
        """
OPTIONAL for optional props; declare contribution class; traverse to method type for method labels; SAMPLE()+GROUP BY for one row per paper when needed.
""",
        """
Empty methods → traverse to method type (collection→method→method type→label). Venue not working → get `?venue rdfs:label ?venue_name` first. Duplicates → SAMPLE() with GROUP BY.
""",
    ),
    (
        "R1544125",
        "NLP for Requirements Engineering (NLP4RE)",
        """
NLP4RE: NLP/RE tasks, evaluation metrics, datasets, annotation, baselines. Use `?contribution a orkgc:C121001`. Evaluation: HAS_EVALUATION → P110006 (metrics). NLP tasks: P181003 → P181004. RE tasks: P181002. Datasets: P181011 → P181022 → P181023. Annotation: P181031 → P181036 → P181038.
""",
        "",
        """
Class: `?contribution a orkgc:C121001`. Use SELECT DISTINCT. OPTIONAL for labels. Top N: include ?paper and ?paperLabel, no LIMIT, ORDER BY ?paperLabel. Traverse full chains (e.g. dataset→datatype→dataformat; HAS_EVALUATION→evaluation→P110006).
""",
        """
DISTINCT; OPTIONAL for labels; full property chains; for "top N" return ?paper ?paperLabel + field, no LIMIT.
""",
        """
Duplicates → SELECT DISTINCT. Missing labels → OPTIONAL { rdfs:label }. Empty nested → traverse full chain. Metrics → HAS_EVALUATION then P110006.
""",
    ),
]
