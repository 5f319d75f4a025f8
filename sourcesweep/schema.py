"""Table schemas used across the package (DDL strings, ready for ``spark.read.schema``)."""

FILES = "project string, path string, name string, ext string, content string"

DEPS = "project string, path string, dep_seq int, name string, version string, type string"

ADVISORY = (
    "id string, source string, description string, cvss_score double, severity string, "
    "`references` array<string>, published string, cwe array<string>, "
    "affected_versions string, remediation string"
)

FINDINGS = (
    "project string, path string, line int, analyzer string, category string, severity string, "
    "rule_id string, issue string, message string, recommendation string, snippet string"
)
FINDING_COLUMNS = [c.strip().split(" ")[0] for c in FINDINGS.split(",")]

NVD_RAW = (
    "vulnerabilities array<struct<cve: struct<"
    "id: string, published: string, "
    "descriptions: array<struct<lang: string, value: string>>, "
    "metrics: struct<"
    "cvssMetricV31: array<struct<cvssData: struct<baseScore: double>>>, "
    "cvssMetricV30: array<struct<cvssData: struct<baseScore: double>>>, "
    "cvssMetricV2: array<struct<cvssData: struct<baseScore: double>>>>, "
    "weaknesses: array<struct<description: array<struct<value: string>>>>, "
    "`references`: array<struct<url: string>>>>>"
)

# ``references`` items and ``database_specific`` are open in the feed: items may be plain strings
# and the object may hold anything, so both are read as text and picked apart later.
OSV_RAW = (
    "id string, summary string, details string, published string, "
    "severity array<struct<type: string, score: string>>, "
    "database_specific map<string, string>, "
    "affected array<struct<package: struct<name: string, ecosystem: string>, "
    "versions: array<string>, "
    "ranges: array<struct<type: string, events: array<map<string, string>>>>>>, "
    "`references` array<string>"
)

GHSA_RAW = (
    "package string, ecosystem string, "
    "advisory struct<ghsaId: string, summary: string, description: string, severity: string, "
    "publishedAt: string, `references`: array<struct<url: string>>, "
    "cvss: struct<score: double>, cwes: struct<nodes: array<struct<cweId: string>>>>, "
    "vulnerableVersionRange string, firstPatchedVersion struct<identifier: string>"
)
