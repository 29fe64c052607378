"""Skill, alias, role and seniority vocabulary.

A *phrase* is plain lower-case text; it stands for the regular expression
``\\b`` + phrase with every blank read as optional white space + ``\\b``
(`phrase_regex`). Everything that follows mechanically from the tables - regexes,
token gates, the alias dictionary, the implied skills per role and level - is built
by rule from them. Whole dictionaries of aliases and of skills by role are inputs: files
(`postmill.sources.dictionaries`) or tables (`postmill.operators.dictionary`).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

LEVELS = ("junior", "mid", "senior")


@dataclass(frozen=True)
class Skill:
    """One tagging rule.

    `words`: phrases that tag the skill and are also aliases of its name.
    `tags`: phrases that only tag.
    `unless`: (phrase, continuation): the phrase tags unless the continuation regex follows.
    `regexes`: (stems, regex) pairs for the few rules that are no phrase.
    """

    name: str
    words: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    unless: tuple[tuple[str, str], ...] = ()
    regexes: tuple[tuple[str, str], ...] = ()


# Tagging rules in the order in which tags are reported.
SKILLS: tuple[Skill, ...] = (
    Skill("JavaScript", ("javascript", "js", "vanilla js", "ecmascript"), ("ecmscript", "emascript", "emscript")),
    Skill("TypeScript", ("typescript", "ts"), ("type script",)),
    Skill("Python", ("python", "python3", "py")),
    Skill("Java", ("java se", "java ee", "jdk", "jre"), unless=(("java", r"\s*script"),)),
    Skill("C#", ("c#", "csharp", "c-sharp", "dotnet", ".net")),
    Skill("C++", ("c++", "cplusplus", "cpp")),
    Skill("PHP", ("php",), regexes=(("php", r"\bphp\d+\b"),)),
    Skill("Ruby", ("rb",), unless=(("ruby", r"\s*on\s*rails"),)),
    Skill("Go", ("golang",), regexes=(("go", r"\bgo\s+(?:lang|programming|language|developer|dev)\b"),)),
    Skill("Rust", unless=(("rust", r"\s"),), regexes=(("rust", r"\brust\s+(?:lang|programming|language)\b"),)),
    Skill("Swift", ("swift",), ("swift ui", "ios swift")),
    Skill("Kotlin", ("kotlin",), ("kotlin native",)),
    Skill("Scala", ("scala",)),
    Skill("React", ("react", "reactjs", "react.js"), ("react native",)),
    Skill("Angular", ("angular", "angularjs"), regexes=(("angular", r"\bangular\s*\d+\b"),)),
    Skill("Vue.js", ("vue", "vuejs", "vue.js", "nuxt")),
    Skill("HTML", ("html", "html5"), ("markup",)),
    Skill("CSS", ("css", "css3"), ("stylesheet", "styling")),
    Skill("Sass", ("sass", "scss", "less", "stylus")),
    Skill("Bootstrap", ("bootstrap",), regexes=(("bs", r"\bbs\d+\b"),)),
    Skill("Tailwind CSS", ("tailwind", "tailwindcss"), ("tailwind css",)),
    Skill("Material-UI", ("mui", "material design"), ("material ui",)),
    Skill("Redux", ("redux", "redux toolkit", "rtk")),
    Skill("jQuery", ("jquery", "jq")),
    Skill("Build Tools", ("webpack", "vite", "parcel", "rollup")),
    Skill("Node.js", ("node", "nodejs", "node.js", "server side js")),
    Skill("Express", ("express", "expressjs", "express.js")),
    Skill("Django", ("django", "django rest", "drf")),
    Skill("Flask", ("flask", "flask api")),
    Skill("Laravel", ("laravel", "php laravel")),
    Skill("Spring", ("spring", "spring boot", "spring framework")),
    Skill("Ruby on Rails", ("ruby on rails", "rails", "ror")),
    Skill("ASP.NET", ("asp.net", "aspnet")),
    Skill("FastAPI", ("fastapi", "fast api")),
    Skill("NestJS", ("nestjs", "nest.js", "nest framework")),
    Skill("MySQL", ("mysql", "my sql", "mariadb")),
    Skill("PostgreSQL", ("postgresql", "postgres", "psql")),
    Skill("MongoDB", ("mongodb", "mongo", "nosql")),
    Skill("Redis", ("redis", "caching", "memcached")),
    Skill("Elasticsearch", ("elasticsearch", "elastic", "es", "elk")),
    Skill("SQLite", ("sqlite", "sql lite")),
    Skill("Oracle", ("oracle", "oracle db")),
    Skill("SQL Server", ("sql server", "mssql", "microsoft sql")),
    Skill("DynamoDB", ("dynamodb", "dynamo db")),
    Skill("Cassandra", ("cassandra", "cql")),
    Skill("AWS", ("aws", "amazon web services", "ec2", "s3", "lambda", "rds")),
    Skill("Azure", ("azure", "microsoft azure", "azure cloud")),
    Skill("Google Cloud", ("gcp", "google cloud", "gce", "gke")),
    Skill("Firebase", ("firebase", "firestore")),
    Skill("Cloud Hosting", ("heroku", "digital ocean", "linode")),
    Skill("Docker", ("docker", "containerization", "container")),
    Skill("Kubernetes", ("kubernetes", "k8s", "orchestration")),
    Skill("CI/CD", ("jenkins", "ci cd", "continuous integration")),
    Skill("GitLab", ("gitlab", "gitlab ci")),
    Skill("GitHub", ("github", "github actions")),
    Skill("Terraform", ("terraform", "infrastructure as code", "iac")),
    Skill("Ansible", ("ansible", "playbook")),
    Skill("Git", ("git", "version control", "vcs")),
    Skill("React Native", ("react native", "rnative")),
    Skill("Flutter", tags=("flutter", "dart")),
    Skill("iOS Development", ("ios", "xcode", "swiftui")),
    Skill("Android Development", ("android", "android studio", "jetpack")),
    Skill("Testing", ("jest", "mocha", "chai", "unit test")),
    Skill("E2E Testing", ("cypress", "selenium", "e2e", "integration test")),
    Skill("REST API", ("rest", "restful", "rest api")),
    Skill("GraphQL", ("graphql", "apollo")),
    Skill("Microservices", ("microservices", "microservice", "service oriented")),
    Skill("API Development", ("api", "webservice", "web service")),
    Skill("Agile", ("agile", "scrum", "kanban")),
    Skill("DevOps", ("devops", "sre", "site reliability")),
    Skill("Machine Learning", ("machine learning", "ml", "artificial intelligence")),
    Skill("Data Science", ("data science",), ("data analysis", "analytics")),
    Skill("Big Data", ("big data", "hadoop", "spark", "kafka")),
    Skill("Data Analysis", ("pandas", "numpy", "scikit", "tensorflow", "pytorch")),
    Skill("Data Visualization", ("tableau", "power bi", "loker", "data visual")),
    Skill("Project Management", ("project management",), ("jira", "confluence")),
    Skill("SQL", ("query", "database"), unless=(("sql", r"\s*server"),)),
    Skill("Linux", ("linux", "unix", "bash", "shell")),
    Skill("WebSockets", ("websocket", "socket.io", "real-time"), ("realtime",)),
    Skill("State Management", ("redux saga", "redux thunk", "state management")),
    Skill("Next.js", ("next.js", "nextjs", "server side rendering", "ssr")),
    Skill("Gatsby", ("gatsbyjs", "gatsby", "static site")),
    Skill("Build Tools", ("webpack", "babel", "esbuild")),
    Skill("Data Formats", ("json", "xml", "yaml")),
    Skill("Frontend Development", ("frontend", "front-end", "front end")),
    Skill("Backend Development", ("backend", "back-end", "back end")),
    Skill("Full Stack Development", ("fullstack", "full-stack", "full stack")),
    Skill("Mobile Development", ("mobile dev", "mobile app", "app development")),
)

# Spellings of skills that are no tagging phrases.
ALIASES: dict[str, str] = {
    "java": "Java",
    "ruby": "Ruby",
    "go": "Go",
    "rust": "Rust",
    "bs": "Bootstrap",
    "material-ui": "Material-UI",
    "pg": "PostgreSQL",
    "ci/cd": "CI/CD",
    "ai": "Machine Learning",
    "data analysis": "Data Analysis",
    "analytics": "Data Analysis",
    "powerbi": "Data Visualization",
    "sql": "SQL",
    "flutter": "Flutter",
    "jira": "JIRA",
    "confluence": "Confluence",
    "inclusive design": "Accessibility",
    "solid": "SOLID Principles",
    "event-driven": "Event-Driven Architecture",
    "event driven": "Event-Driven Architecture",
    "ddd": "Domain-Driven Design",
    "firmware": "Firmware",
    "nft": "NFT",
    "layer 1": "Layer 1",
    "dao": "DAO",
    "vr": "VR",
    "ar": "AR",
    "point cloud": "Point Cloud Processing",
    "wasm": "WebAssembly",
    "ebpf": "eBPF",
    "ids": "IDS/IPS",
    "ips": "IDS/IPS",
}


@dataclass(frozen=True)
class Role:
    """`phrases` as above; `followed`/`unless`: phrase with / without one of the words after it."""

    name: str
    phrases: tuple[str, ...]
    followed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    unless: tuple[tuple[str, tuple[str, ...]], ...] = ()


# Title rules per role, in dictionary order.
ROLES: tuple[Role, ...] = (
    Role(
        "frontend",
        ("frontend", "front-end", "front end", "front end (developer|engineer)", "ui developer", "ui engineer"),
        unless=(("web developer", ("java", "php", "python", "node", "backend", "full")),),
    ),
    Role(
        "backend",
        ("backend", "back-end", "back end", "backend (developer|engineer)", "server (developer|engineer)", "api (developer|engineer)"),
    ),
    Role("fullstack", ("fullstack", "full-stack", "full stack", "full stack (developer|engineer)")),
    Role(
        "mobile",
        ("mobile", "android", "ios", "flutter", "react native", "xamarin", "app developer", "mobile (developer|engineer|app)"),
    ),
    Role(
        "devops",
        ("devops", "sre", "site reliability", "platform engineer", "infra engineer"),
        unless=(("cloud engineer", ("aws", "azure", "gcp")), ("operations", ("manager", "analyst"))),
    ),
    Role(
        "qa",
        ("qa", "quality", "test(er|ing|automation)?", "automation (engineer|tester|developer)", "qatest", "test engineer"),
    ),
    Role("data", ("data (engineer|analyst|scientist)",), followed=(("data", ("management", "warehouse", "platform")),)),
    Role(
        "data-science",
        ("data scientist", "data science"),
        followed=(("research scientist", ("machine", "ml", "ai")),),
    ),
    Role(
        "ml",
        ("machine learning", "ml engineer", "ai engineer", "ai research"),
        unless=(("ml", ("engineer", "model")),),
    ),
    Role("security", ("security", "cyber", "penetration", "appsec", "infosec", "security engineer", "security analyst")),
    Role("dba", ("dba", "database (admin|engineer|architect)", "data admin")),
    Role(
        "cloud",
        ("aws", "azure", "gcp", "cloud (engineer|architect|developer)"),
        unless=(("cloud", ("engineer", "architect")),),
    ),
    Role(
        "embedded",
        ("embedded", "firmware", "realtime", "microcontroller"),
        followed=(("ios", ("engineer", "developer")),),
    ),
    Role(
        "blockchain",
        ("blockchain", "web3", "solidity"),
        followed=(("crypto", ("developer", "engineer")), ("nft", ("developer", "engineer"))),
    ),
    Role(
        "game-dev",
        ("game (developer|engineer|designer)", "gameplay"),
        followed=(("unity", ("developer", "engineer")), ("unreal", ("developer", "engineer"))),
    ),
    Role("ar-vr", ("ar", "vr", "mixed reality", "xr", "metaverse")),
    Role("network", ("network(ing)? (engineer|admin|architect)", "network engineer", "cisco")),
    Role(
        "systems",
        ("systems? (engineer|programmer|developer)", "system programmer"),
        followed=(("core", ("engineer", "developer")),),
    ),
    Role(
        "ui-ux",
        (r"ui[\s-]*ux", "user interface", "user experience", "ux designer", "ui designer", "product designer"),
    ),
    Role(
        "software-architecture",
        ("software architect", "solutions? architect", "system architect", "enterprise architect"),
        followed=(("architect", ("aws", "azure", "cloud", "solutions")),),
    ),
    Role(
        "product",
        ("product manager", "product owner"),
        followed=(("pm", ("google", "facebook", "amazon", "apple", "microsoft")),),
    ),
    Role(
        "technical-writer",
        ("technical writer", "technical author", "docs? engineer"),
        followed=(("documentation", ("specialist", "engineer")),),
    ),
    Role(
        "sales-engineer",
        ("sales engineer",),
        followed=(("se", ("aws", "azure", "gcp", "technical")),),
        unless=(("solutions engineer", ("cloud", "kubernetes")),),
    ),
    Role("site-reliability", ("sre", "site reliability", "reliability engineer")),
    Role("platform", ("platform (engineer|developer)", "developer experience", "devex")),
    Role(
        "analytics",
        ("business analyst", "bi analyst"),
        followed=(("analytics", ("engineer", "manager", "analyst")),),
    ),
    Role(
        "growth",
        ("growth marketing",),
        followed=(("growth", ("engineer", "manager", "marketing", "hacker")),),
    ),
)

# Seniority markers in titles.
SENIOR_MARKERS = (
    "senior", "sr", "lead", "staff", "principal", "architect", "head", "director", "manager", "vp",
    r"[5678] \+ years", r"10 \+ years", r"10\+? yrs",
)
JUNIOR_MARKERS = (
    "junior", "jr", "entry", "associate", "intern", "internship", "graduate", r"new\x20grad", "[01]-[23] years",
)

# Skills implied by a role at each level. Only the most common roles are built
# in; a dictionary for every role is an input (`sources.dictionaries.read_role_skills`).
ROLE_SKILLS: dict[str, dict[str, tuple[str, ...]]] = {
    "frontend": {
        "junior": ("HTML", "CSS", "JavaScript", "Git", "DOM", "Responsive Design", "Chrome DevTools"),
        "mid": ("TypeScript", "React", "Vue.js", "Angular", "Sass", "Webpack", "Redux", "REST API", "Figma"),
        "senior": (
            "Next.js", "GraphQL", "Server-Side Rendering", "Performance Optimization", "WebSockets", "Testing",
            "Design Systems", "Micro-frontends", "WebAssembly",
        ),
    },
    "backend": {
        "junior": ("Git", "REST API", "SQL", "HTTP", "JSON", "Authentication", "Validation"),
        "mid": (
            "Node.js", "Express", "Python", "Django", "Flask", "PostgreSQL", "MongoDB", "Redis", "Docker",
            "Authentication", "Caching", "API Design",
        ),
        "senior": (
            "Microservices", "Message Queues", "GraphQL", "gRPC", "Kubernetes", "Event-Driven Architecture", "CQRS",
            "Saga Pattern", "API Gateway", "Service Mesh", "Observability",
        ),
    },
    "fullstack": {
        "junior": ("HTML", "CSS", "JavaScript", "Git", "SQL", "REST API", "DOM", "Responsive Design"),
        "mid": (
            "TypeScript", "React", "Vue.js", "Node.js", "Express", "PostgreSQL", "MongoDB", "Docker", "Git",
            "REST API", "Authentication", "Deployment",
        ),
        "senior": (
            "Next.js", "GraphQL", "Microservices", "Kubernetes", "Redis", "WebSockets", "CI/CD", "Testing",
            "Performance Optimization", "Server-Side Rendering", "Event-Driven Architecture",
        ),
    },
    "mobile": {
        "junior": ("Git", "REST API", "JSON", "HTTP", "Mobile UI Principles"),
        "mid": (
            "React Native", "Flutter", "iOS Development", "Android Development", "TypeScript", "JavaScript",
            "State Management", "Navigation", "API Integration",
        ),
        "senior": (
            "Native Modules", "Performance Optimization", "App Store Deployment", "CI/CD for Mobile",
            "Push Notifications", "Offline-First Architecture", "Deep Linking", "Mobile Security",
        ),
    },
    "devops": {
        "junior": ("Git", "Linux", "Docker", "Shell Scripting", "CI/CD", "GitHub Actions", "Monitoring"),
        "mid": (
            "Kubernetes", "Terraform", "Ansible", "Jenkins", "AWS", "Azure", "Google Cloud", "Prometheus", "Grafana",
            "ELK Stack", "Container Orchestration",
        ),
        "senior": (
            "Service Mesh", "Istio", "Linkerd", "Observability", "Chaos Engineering", "GitOps", "FinOps",
            "Security Scanning", "Kubernetes Operators", "Custom Operators", "Multi-Cloud", "Disaster Recovery",
        ),
    },
    "qa": {
        "junior": ("Git", "Test Cases", "Bug Reporting", "TestRail", "JIRA", "Regression Testing"),
        "mid": (
            "Selenium", "Cypress", "Playwright", "Jest", "Mocha", "Chai", "API Testing", "Postman", "SQL", "CI/CD",
            "Test Automation",
        ),
        "senior": (
            "Test Strategy", "Performance Testing", "Security Testing", "Automated Framework Design", "BDD",
            "Selenium Grid", "Mobile Testing", "Visual Regression", "Test Data Management", "Quality Metrics",
        ),
    },
    "data": {
        "junior": ("SQL", "Excel", "Python", "Git", "Data Cleaning", "ETL", "JSON", "CSV"),
        "mid": (
            "PostgreSQL", "MySQL", "MongoDB", "Pandas", "NumPy", "ETL Pipelines", "Data Warehousing", "Tableau",
            "Power BI", "Apache Airflow", "SQL Optimization",
        ),
        "senior": (
            "Spark", "Kafka", "Big Data", "Data Lake", "Data Mesh", "Machine Learning", "Feature Engineering",
            "Real-Time Analytics", "dbt", "Data Governance", "Data Quality",
        ),
    },
}

RoleSkills = Mapping[str, Mapping[str, Sequence[str]]]


def phrase_regex(phrase: str, literal: bool = True, space: str = r"\s", edges: tuple[str, str] = (r"\b", r"\b")) -> str:
    """The regular expression a phrase stands for."""
    parts = [re.escape(p) if literal else p for p in phrase.split(" ")]
    return edges[0] + f"{space}*".join(parts) + edges[1]


def alias_dictionary(overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """Lower-case spelling -> canonical skill name: every tagging phrase's skill, then `ALIASES`.

    `overrides` (a full dictionary file, say) is applied last.
    """
    aliases = {spelling: skill.name for skill in SKILLS for spelling in skill.words}
    return {**aliases, **ALIASES, **(overrides or {})}


def normalize(skill: str, aliases: Mapping[str, str]) -> str:
    """Dictionary-time twin of `functions.skills.normalize_skill`."""
    skill = skill.strip()
    return aliases.get(skill.lower()) or skill


def implied(role: str, level: str, role_skills: RoleSkills = ROLE_SKILLS) -> list[str]:
    """Skills of all levels up to `level`, first occurrence kept; nothing for an unknown role."""
    levels = role_skills.get(role, {})
    names = [n for lv in LEVELS[: LEVELS.index(level) + 1] for n in levels.get(lv, ())]
    return list(dict.fromkeys(names))


def role_skill_rows(role_skills: RoleSkills = ROLE_SKILLS) -> list[tuple[str, str, int, int, str]]:
    """Long form (role, level, level_rank, pos, skill) of a role dictionary."""
    return [
        (role, level, rank, pos, name)
        for role, levels in role_skills.items()
        for rank, level in enumerate(LEVELS)
        for pos, name in enumerate(levels.get(level, ()))
    ]
