"""Quality metrics of skills: complexity, lines, documentation, dependencies, maintenance.

Each file gives a row of counts in the one pass over contents; a skill's metrics
come from one aggregation of these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.dialect import jvm_exact
from scanloom.operators.contents import marked, passed
from scanloom.operators.measures import BRANCH_WEIGHTS, LICENSE_NAMES, PARTS
from scanloom.operators.scoring import half_up, two_places

# Names of files.
TEST_FILES = [
    r"\.test\.[jt]sx?$", r"\.spec\.[jt]sx?$", r"_test\.[jt]sx?$", r"test_.*\.py$", r".*_test\.py$", r"\.test\.py$", r"tests?\/.*\.[jt]sx?$", r"tests?\/.*\.py$",
    r"__tests__\/", r"\.stories\.[jt]sx?$",
]
CI_FILES = [
    (".github/workflows", "GitHub Actions"), (".gitlab-ci.yml", "GitLab CI"), (".circleci/config.yml", "CircleCI"), ("Jenkinsfile", "Jenkins"), (".travis.yml", "Travis CI"),
    ("azure-pipelines.yml", "Azure Pipelines"), ("bitbucket-pipelines.yml", "Bitbucket Pipelines"), (".buildkite", "Buildkite"), (".drone.yml", "Drone CI"), ("turbo.json", "Turborepo"),
]
LINTERS = [
    ".eslintrc", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.json", ".eslintrc.yml", "eslint.config.js", "eslint.config.mjs", "eslint.config.cjs", ".pylintrc", "pyproject.toml", ".flake8", ".ruff.toml", "ruff.toml", "deno.json",
]
FORMATTERS = [
    ".prettierrc", ".prettierrc.js", ".prettierrc.cjs", ".prettierrc.json", ".prettierrc.yml", ".prettierrc.toml", "prettier.config.js", "prettier.config.cjs", ".editorconfig", "deno.json", ".clang-format", "rustfmt.toml",
]
LOCKFILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock", "Pipfile.lock", "poetry.lock", "requirements.txt"]
SOURCE_EXTENSIONS = "ts tsx js jsx mjs cjs py rb rs go java kt swift c cpp h hpp".split()
POINTS = {"tests": 25, "ci": 20, "types": 20, "license": 15, "linter": 10, "formatter": 5, "gitignore": 5}
TEXT_SHARES = {"readme": 0.35, "comments": 0.30, "docstrings": 0.35}


def file_metrics(files: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row per file with its counts; of the parts not asked for these are zero.

    files: as for ``read_contents``, or what that returns.
    """
    f = passed(files, ["JS_DOC_TYPES", "PYTHON_TYPES"], parts)
    path, m = F.col("rel_path"), lambda name: F.col(f"measured.{name}")
    base, low, ext = F.substring_index(path, "/", -1), F.lower(path), F.lower(F.substring_index(path, ".", -1))
    test = F.lit(False)
    for p in TEST_FILES:
        test = test | path.rlike(jvm_exact(p))
    ci = F.lit(None).cast("int")
    for i, (name, _) in reversed(list(enumerate(CI_FILES))):
        ci = F.when((path == name) | path.startswith(f"{name}/"), i).otherwise(ci)
    return f.select(
        "skill_id", "rel_path", m("kind").alias("kind"), F.map_from_arrays(F.array(*map(F.lit, BRANCH_WEIGHTS)), m("branches")).alias("branches"),
        F.struct(m("code").alias("code"), m("comments").alias("comments"), m("lines").alias("lines")).alias("counted"),
        m("docstrings").alias("docstrings"), m("functions").alias("functions"),
        F.when(low.isin("readme.md", "readme"), 0).when(low == "skill.md", 1).alias("readme_rank"), m("readme_score").alias("readme_score"),
        test.alias("is_test"), ext.isin("js", "ts", "jsx", "tsx", "py", "mjs", "cjs").alias("is_tested_source"), ext.isin(*SOURCE_EXTENSIONS, "sol").alias("executable"),
        ext.isin(*SOURCE_EXTENSIONS).alias("maintained"), ci.alias("ci"), path.endswith(".d.ts").alias("dts"),
        (path.isin("tsconfig.json", "tsconfig.build.json") | path.endswith("/tsconfig.json")).alias("tsconfig"), ext.isin("ts", "tsx").alias("typescript"),
        ((path.endswith(".js") | path.endswith(".jsx")) & marked("JS_DOC_TYPES")).alias("jsdoc_types"), (path.endswith(".py") & marked("PYTHON_TYPES")).alias("python_types"),
        low.isin(*LICENSE_NAMES).alias("license_file"), m("license_type").alias("license_type"), m("package_license").alias("package_license"),
        base.isin(*LINTERS).alias("linter"), m("lint_script").alias("lint_script"),
        base.isin(*FORMATTERS).alias("formatter"), ((path == ".gitignore") | path.endswith("/.gitignore")).alias("gitignore"), base.isin(*LOCKFILES).alias("lockfile"),
    )


def _piecewise(x: Column, steps: list[tuple[float, float, float]], last: float) -> Column:
    """Linear between points: (upper bound, value at the lower bound, value at the upper bound)."""
    out, low = F.lit(last), 0.0
    pieces = []
    for high, at_low, at_high in steps:
        pieces.append((high, at_low + (x - low) / (high - low) * (at_high - at_low)))
        low = high
    for high, value in reversed(pieces):
        out = F.when(x < high, value).otherwise(out)
    return out


def declared_dependencies(skills: DataFrame, files: DataFrame) -> DataFrame:
    """(skill_id, name, source): each dependency once, from the manifest, package.json, its development part, requirements, pyproject."""
    content, path = F.coalesce("content", F.lit("")), F.col("rel_path")
    lists = "map<string,string>"
    first = files.filter((path == "package.json") | path.endswith("/package.json")).groupBy("skill_id").agg(F.min_by(content, F.struct("file_ord", "rel_path")).alias("content"))
    of = lambda df, names, k: df.select("skill_id", F.explode(names).alias("name"), F.lit(k).alias("k"))
    keys = lambda p: F.map_keys(F.from_json(F.get_json_object("content", p), lists))
    required = files.filter(path.isin("requirements.txt", "requirements/base.txt", "requirements/prod.txt")).groupBy("skill_id").agg(F.min_by(content, F.struct("file_ord", "rel_path")).alias("content"))
    names = lambda lines: F.filter(F.transform(lines, lambda x: F.regexp_extract(F.trim(x), "^([a-zA-Z0-9_-]+)", 1)), lambda x: (x != "") & ~x.startswith("-"))
    project = files.filter(path == "pyproject.toml").select("skill_id", F.regexp_extract(content, r"(?s)\[project\].*?dependencies\s*=\s*\[(.*?)\]", 1).alias("block"))
    rows = (
        of(skills, F.map_keys("manifest.dependencies"), 0)
        .union(of(first, keys("$.dependencies"), 1))
        .union(of(first, keys("$.devDependencies"), 2))
        .union(of(required, names(F.split("content", "\n")), 3))
        .union(of(project, names(F.split(F.regexp_replace("block", '[",]', ""), "\n")), 4))
    )
    source = F.try_element_at(F.array(*map(F.lit, ("manifest", "package", "development", "requirements", "pyproject"))), F.col("k") + 1)
    return rows.groupBy("skill_id", "name").agg(F.min("k").alias("k")).select("skill_id", "name", source.alias("source"))


def skill_metrics(skills: DataFrame, files: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """One row of metrics per skill, also of those without files.

    read: the files after ``read_contents``, where the caller holds them.  Test coverage is null: it cannot be told from files.
    """
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    source = F.col("kind") != "unknown"
    branches = [total(F.element_at("branches", F.lit(k))).alias(f"b{i}") for i, k in enumerate(BRANCH_WEIGHTS)]
    per = file_metrics(files if read is None else read).groupBy("skill_id").agg(
        *branches,
        total(F.col("counted.code")).alias("lines_of_code"),
        total(F.when(source, F.col("counted.comments"))).alias("comments"), total(F.when(source, F.col("counted.lines"))).alias("source_lines"),
        total("docstrings").alias("docstrings"), total("functions").alias("functions"), any_(source).alias("has_text_source"),
        F.min(F.when(F.col("readme_rank").isNotNull(), F.struct("readme_rank", "rel_path", "readme_score"))).alias("readme"),
        total(F.col("is_test").cast("int")).alias("tests"), total((F.col("is_tested_source") & ~F.col("is_test")).cast("int")).alias("tested"),
        any_("executable").alias("has_source"), any_("maintained").alias("maintained"), F.min("ci").alias("ci"),
        *[any_(c).alias(c) for c in ("dts", "tsconfig", "typescript", "jsdoc_types", "python_types", "license_file", "linter", "lint_script", "formatter", "gitignore", "lockfile")],
        F.max("license_type").alias("license_type"), F.max("package_license").alias("package_license"),
    )
    deps = declared_dependencies(skills, files).groupBy("skill_id").agg(F.count("*").alias("dependency_count"))
    m = skills.select("skill_id", F.col("manifest.license").alias("manifest_license")).join(per, "skill_id", "left").join(deps, "skill_id", "left")
    numbers = [f"b{i}" for i in range(len(BRANCH_WEIGHTS))] + ["lines_of_code", "comments", "source_lines", "docstrings", "functions", "tests", "tested", "dependency_count"]
    flags = "has_text_source has_source maintained dts tsconfig typescript jsdoc_types python_types license_file linter lint_script formatter gitignore lockfile".split()
    m = m.fillna(0, numbers).fillna(False, flags)
    complexity = F.lit(0.0)
    for i, w in enumerate(BRANCH_WEIGHTS.values()):
        complexity = complexity + F.col(f"b{i}") * w
    ratio = F.col("comments") / F.col("source_lines")
    comments = F.when(F.col("source_lines") == 0, 0.0).otherwise(two_places(F.when(ratio > 0.4, 0.6).otherwise(_piecewise(ratio, [(0.03, 0.0, 0.3), (0.1, 0.3, 0.7), (0.25, 0.7, 1.0)], 1.0) - F.greatest(F.lit(0.0), (ratio - 0.25) / 0.15 * 0.2))))
    covered = F.col("docstrings") / F.col("functions")
    docstrings = F.when(F.col("functions") == 0, F.when(F.col("docstrings") > 0, 0.5).otherwise(0.0)).otherwise(two_places(_piecewise(covered, [(0.2, 0.0, 0.3), (0.5, 0.3, 0.6), (0.8, 0.6, 1.0)], 1.0)))
    readme = F.coalesce("readme.readme_score", F.lit(0.0))
    text = F.when(F.col("has_text_source"), readme * TEXT_SHARES["readme"] + comments * TEXT_SHARES["comments"] + docstrings * TEXT_SHARES["docstrings"]).otherwise(readme)
    tested = F.col("tests") / F.col("tested")
    testing = F.when(F.col("tests") == 0, 0.0).when(F.col("tested") == 0, 1.0).otherwise(_piecewise(tested, [(0.2, 0.0, 0.4), (0.5, 0.4, 0.7), (0.8, 0.7, 1.0)], 1.0))
    typed = F.when(F.col("typescript") | F.col("python_types"), 1.0).when(F.col("dts"), 0.8).when(F.col("jsdoc_types"), 0.6).when(F.col("tsconfig"), 0.5).otherwise(0.0)
    licensed = (F.coalesce("manifest_license", F.lit("")) != "") | F.col("license_file") | (F.coalesce("package_license", F.lit("")) != "")
    or_full = lambda c: F.when(F.col("maintained"), c).otherwise(1.0)
    yes = lambda c: c.cast("double")
    parts = {
        "tests": or_full(testing), "ci": or_full(yes(F.col("ci").isNotNull())), "types": or_full(typed), "license": yes(licensed),
        "linter": or_full(F.when(F.col("linter"), 1.0).when(F.col("lint_script"), 0.8).otherwise(0.0)), "formatter": or_full(yes(F.col("formatter"))), "gitignore": yes(F.col("gitignore")),
    }
    health = F.lit(0)
    for k, c in parts.items():
        health = health + half_up(c * POINTS[k])
    return m.select(
        "skill_id", two_places(complexity).alias("code_complexity"), F.lit(None).cast("double").alias("test_coverage"), two_places(text).alias("documentation_score"),
        F.least(F.lit(100), health).cast("double").alias("maintenance_health"), F.col("dependency_count").cast("int").alias("dependency_count"),
        F.when(F.col("lockfile"), 0).otherwise(F.col("dependency_count")).cast("int").alias("outdated_dependencies"), F.col("readme").isNotNull().alias("has_readme"),
        licensed.alias("has_license"), F.coalesce("manifest_license", "license_type", "package_license").alias("license_type"), (F.col("tests") > 0).alias("has_tests"),
        (F.col("dts") | F.col("tsconfig") | F.col("typescript") | F.col("jsdoc_types") | F.col("python_types")).alias("has_types"), F.col("lines_of_code").cast("int").alias("lines_of_code"), "has_source",
        F.try_element_at(F.array(*[F.lit(n) for _, n in CI_FILES]), F.col("ci") + 1).alias("ci_provider"),
    )


def branch_table(files: DataFrame) -> DataFrame:
    """(skill_id, branch, n, weight): branch kinds that occur, by what they add to the complexity."""
    weights = F.create_map(*[F.lit(x) for pair in BRANCH_WEIGHTS.items() for x in pair])
    rows = file_metrics(files, ("branches",)).select("skill_id", F.explode("branches").alias("branch", "n"))
    out = rows.groupBy("skill_id", "branch").agg(F.sum("n").alias("n")).filter("n > 0").withColumn("weight", F.element_at(weights, F.col("branch")))
    return out.orderBy("skill_id", F.desc(F.col("n") * F.col("weight")), "branch")


def recommendations(skills: DataFrame, findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """(skill_id, ord, category, priority, title, description, effort): up to six for each skill, in a fixed order."""
    n = findings.groupBy("skill_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    rows = skills.select("skill_id").join(n, "skill_id", "left").fillna(0, ["critical", "high"]).join(metrics, "skill_id")

    def advice(test: Column, category: str, priority: str, effort: str, title: str, text: Column) -> Column:
        return F.when(test, F.struct(F.lit(category).alias("category"), F.lit(priority).alias("priority"), F.lit(title).alias("title"), text.alias("description"), F.lit(effort).alias("effort")))

    counted = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    every = F.array_compact(
        F.array(
            advice(F.col("critical") > 0, "security", "critical", "high", "Address critical security findings immediately", counted("critical", " critical finding(s) to resolve before deployment.")),
            advice(F.col("high") > 0, "security", "high", "medium", "Resolve high-severity security findings", counted("high", " high-severity finding(s) need attention.")),
            advice(F.col("has_source") & ~F.col("has_tests"), "quality", "medium", "medium", "Add automated tests", F.lit("There are no test files.")),
            advice(F.col("has_source") & ~F.col("has_types"), "quality", "low", "low", "Add type definitions", F.lit("There are no type definitions.")),
            advice(~F.col("has_readme"), "maintenance", "low", "low", "Add a README file", F.lit("There is no README.")),
            advice(F.col("outdated_dependencies") > 0, "maintenance", "medium", "low", "Update outdated dependencies", counted("outdated_dependencies", " dependencies are outdated.")),
        )
    )
    return rows.select("skill_id", F.posexplode(every).alias("ord", "r")).select("skill_id", "ord", "r.*")
