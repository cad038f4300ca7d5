"""Skills: canonical names and their scan in prose."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions.text import bind, col, literal_map, strip

# Alias and canonical name.
SKILLS: dict[str, str] = {
    "javascript": "JavaScript", "js": "JavaScript", "ecmascript": "JavaScript", "typescript": "TypeScript", "ts": "TypeScript",
    "python": "Python", "py": "Python", "python3": "Python", "java": "Java", "golang": "Go", "go": "Go",
    "c++": "C++", "cpp": "C++", "c#": "C#", "csharp": "C#",
    "react": "React", "reactjs": "React", "react.js": "React", "react native": "React Native",
    "node": "Node.js", "nodejs": "Node.js", "node.js": "Node.js",
    "django": "Django", "flask": "Flask", "fastapi": "FastAPI", "spring": "Spring", "spring boot": "Spring Boot",
    "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "psql": "PostgreSQL", "mysql": "MySQL",
    "mongodb": "MongoDB", "mongo": "MongoDB", "redis": "Redis",
    "aws": "AWS", "amazon web services": "AWS", "gcp": "GCP", "google cloud": "GCP", "azure": "Azure",
    "docker": "Docker", "kubernetes": "Kubernetes", "k8s": "Kubernetes",
    "tensorflow": "TensorFlow", "tf": "TensorFlow", "pytorch": "PyTorch", "torch": "PyTorch",
    "scikit-learn": "scikit-learn", "sklearn": "scikit-learn", "pandas": "pandas", "numpy": "NumPy",
    "sql": "SQL", "html": "HTML", "css": "CSS", "git": "Git", "graphql": "GraphQL", "rest": "REST",
    "machine learning": "Machine Learning", "ml": "Machine Learning", "deep learning": "Deep Learning",
    "nlp": "NLP", "natural language processing": "NLP",
}


def _key(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " "), F.lit(" .,-"))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(literal_map(table), key)


def canonical_skill(c: str | Column, table: dict[str, str] | None = None) -> Column:
    """The canonical name of an alias; anything else as it is, trimmed; null if blank."""
    s = col(c)
    key = _key(s)
    return F.when(key != "", F.coalesce(_lookup(key, table or SKILLS), strip(s)))


def is_known(c: str | Column, table: dict[str, str] | None = None) -> Column:
    """Whether the skill is in the table."""
    return _lookup(_key(col(c)), table or SKILLS).isNotNull()


def canonical_skills(c: str | Column, table: dict[str, str] | None = None) -> Column:
    """Canonical names of a list, each once whatever its case, in order."""
    named = F.filter(F.transform(col(c), lambda x: canonical_skill(x, table)), lambda x: x.isNotNull())
    return F.filter(named, lambda x, i: F.array_position(F.transform(named, F.lower), F.lower(x)) == i + 1)


def scan_skills(c: str | Column, table: dict[str, str] | None = None) -> Column:
    """Canonical names of the aliases that a text holds as whole words, in the table's order."""
    def held(low: Column) -> Column:
        hits = [F.when(F.contains(low, F.lit(a)) & low.rlike(rf"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])"), F.lit(name)) for a, name in (table or SKILLS).items()]
        return F.array_distinct(F.array_compact(F.array(*hits)))

    return bind(F.lower(col(c)), held)
