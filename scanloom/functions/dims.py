"""Small dimensions: severities, rules, word lists, file kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Severities in order, with score weight, SARIF level and CVSS-like score.
SEVERITIES = [
    ("critical", 0, 10, "error", "9.5"),
    ("high", 1, 7, "error", "7.5"),
    ("medium", 2, 4, "warning", "5.0"),
    ("low", 3, 2, "note", "2.5"),
    ("info", 4, 0, "note", "0.0"),
]
WEIGHT = {name: weight for name, _, weight, _, _ in SEVERITIES}
RANK = {name: rank for name, rank, _, _, _ in SEVERITIES}

# Rules in running order, with category and risk id.
RULES = [
    ("injection", "skill-injection", "AST01"),
    ("permissions", "excessive-permissions", "AST03"),
    ("output-handling", "insecure-output", "AST04"),
    ("dependencies", "dependency-vulnerability", "AST02"),
    ("external-instructions", "untrusted-external-instructions", "AST05"),
    ("storage", "insecure-storage", "AST01"),
    ("logging", "insufficient-logging", "AST08"),
    ("dos", "denial-of-service", "AST06"),
    ("supply-chain", "supply-chain", "AST02"),
    ("error-handling", "improper-error-handling", "AST09"),
    ("deserialization", "unsafe-deserialization", "AST01"),
    ("web3-signing-authority", "web3-signing-authority", "AST-W01"),
    ("web3-permit-capture", "web3-permit-capture", "AST-W02"),
    ("web3-eip7702-delegation", "web3-eip7702-delegation", "AST-W03"),
    ("web3-blind-signing", "web3-blind-signing", "AST-W04"),
    ("web3-rpc-substitution", "web3-rpc-substitution", "AST-W05"),
    ("web3-contract-targets", "web3-contract-targets", "AST-W06"),
    ("web3-bridge-replay", "web3-bridge-replay", "AST-W07"),
    ("web3-mcp-chain-drift", "web3-mcp-chain-drift", "AST-W08"),
    ("web3-session-key-erosion", "web3-session-key-erosion", "AST-W09"),
    ("web3-oracle-manipulation", "web3-oracle-manipulation", "AST-W10"),
    ("web3-key-material-leak", "web3-key-material-leak", "AST-W11"),
    ("web3-no-audit-killswitch", "web3-no-audit-killswitch", "AST-W12"),
    ("web3-no-user-confirmation", "web3-no-audit-killswitch", "AST-W12"),
    ("web3-metadata-completeness", "web3-metadata-completeness", "AST04"),
]
WEB3_RULES = frozenset(name for name, _, _ in RULES if name.startswith("web3-"))

# Extensions that each family of rules reads.
CODE = "ts tsx js jsx mjs cjs py rb go rs java kt sh bash zsh fish".split()
PLAIN_CODE = "ts tsx js jsx mjs cjs py rb go rs java kt".split()
SCRIPT = "ts tsx js jsx mjs cjs".split()
EXTENSIONS = {
    "injection": [*CODE, "yaml", "yml", "json", "toml", "md", "mdx"],
    "permissions": CODE,
    "output-handling": [*PLAIN_CODE, "html", "htm", "ejs", "pug", "hbs", "vue", "svelte"],
    "dependencies": SCRIPT,
    "external-instructions": ["md", "mdx", "txt", "markdown"],
    "storage": [*CODE, "yaml", "yml", "json", "toml", "env", "html", "htm", "vue", "svelte"],
    "logging": CODE,
    "dos": PLAIN_CODE,
    "error-handling": PLAIN_CODE,
    "deserialization": [*PLAIN_CODE, "php"],
    "web3": "ts tsx js jsx mjs cjs py go rs sol json yaml yml md mdx toml".split(),
}

# Permissions, tools and packages that are flagged.
DANGEROUS_PERMISSIONS = {
    "filesystem:write": "high",
    "network:unrestricted": "high",
    "shell:execute": "critical",
    "env:read": "medium",
    "credentials:access": "critical",
    "system:admin": "critical",
    "browser:navigate": "medium",
    "clipboard:read": "medium",
    "clipboard:write": "medium",
}
SHELL_TOOLS = ["bash", "shell", "sh", "execute", "exec", "terminal", "run"]
VULNERABLE = {
    "event-stream": "critical",
    "ua-parser-js": "high",
    "coa": "high",
    "rc": "high",
    "colors": "medium",
    "faker": "medium",
    "node-ipc": "critical",
    "minimist": "medium",
    "qs": "medium",
    "tar": "high",
    "glob-parent": "medium",
    "path-parse": "medium",
}
DEPRECATED = "request node-uuid mkdirp rimraf left-pad querystring nomnom optimist coffee-script natives".split()
TYPOSQUATS = {
    "lodash": ["Iodash", "l0dash", "lodahs", "lodasb", "loddash", "lodassh"],
    "express": ["expres", "expresss", "exppress", "exress", "expess"],
    "react": ["raect", "recat", "reat", "reactt", "reacct"],
    "axios": ["axois", "axiso", "axos", "axioss", "axious"],
    "webpack": ["webpak", "webpck", "weback", "webpackk"],
    "node-fetch": ["node-fech", "node-fetcb", "nodefetch", "node_fetch"],
    "chalk": ["chalks", "chlak", "chulk"],
    "commander": ["comander", "commandr", "commader"],
    "moment": ["momet", "momnet", "momennt"],
    "underscore": ["undersore", "undescore", "uderscore"],
    "cross-env": ["cross-env.js", "crossenv", "cros-env"],
    "dotenv": ["dot-env", "dontenv", "dotenvv"],
    "jsonwebtoken": ["json-web-token", "jsonwebtokn", "jsonwebtken"],
    "mongoose": ["mongose", "mongoosse", "mongosse"],
    "body-parser": ["bodyparser", "body-parsr", "bady-parser"],
    "typescript": ["typescrip", "typscript", "typsecript"],
    "eslint": ["eslit", "es-lint", "elint"],
    "prettier": ["pretier", "prettir", "pretiier"],
}
NODE_BUILTINS = (
    "assert buffer child_process cluster console constants crypto dgram dns domain events fs http https module net os "
    "path punycode querystring readline repl stream string_decoder sys timers tls tty url util v8 vm worker_threads zlib"
).split()
BUN_BUILTINS = ["bun", "bun:test", "bun:ffi", "bun:sqlite"]
LOCKFILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock"]
EXAMPLE_WORDS = "example placeholder xxx your_ replace_ changeme todo fixme test sample demo dummy fake mock".split()
SECRET_IGNORES = [".env", "*.pem", "*.key", "credentials"]

# Files and folders that are not read, and the languages by extension.
SKIPPED = "node_modules .git .hg .svn dist build out .next .nuxt .cache __pycache__ .pytest_cache .mypy_cache venv .venv .env coverage .turbo .DS_Store Thumbs.db".split()
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "sh": "shell", "bash": "shell", "zsh": "shell", "fish": "shell", "rb": "ruby", "rs": "rust", "go": "go",
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "mdx": "markdown", "txt": "text",
    "css": "css", "html": "html", "sql": "sql", "graphql": "graphql", "gql": "graphql", "proto": "protobuf", "lua": "lua",
    "r": "r", "swift": "swift", "kt": "kotlin", "java": "java", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp",
}

MANIFEST_NAMES = ["skill.json", "skill.yaml", "skill.yml", "SKILL.md", "package.json", "manifest.json"]


def severity_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEVERITIES, "severity string, rank int, weight int, sarif_level string, cvss string")


def rule_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, c, o, i) for i, (r, c, o) in enumerate(RULES)], "rule string, category string, owasp_id string, rule_ord int")
