"""A project folder as members: Spark reads the files, and their paths tell what they are."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder, pattern of a file's path in it (its group is the member's name), member type. Fixed values.
FOLDERS = [
    ("classes", r"/classes/([^/]+)\.cls$", "ApexClass"),
    ("triggers", r"/triggers/([^/]+)\.trigger$", "ApexTrigger"),
    ("pages", r"/pages/([^/]+)\.page$", "ApexPage"),
    ("components", r"/components/([^/]+)\.component$", "ApexComponent"),
    ("flows", r"/flows/([^/]+)\.flow-meta\.xml$", "Flow"),
    ("layouts", r"/layouts/([^/]+)\.layout-meta\.xml$", "Layout"),
    ("flexipages", r"/flexipages/([^/]+)\.flexipage-meta\.xml$", "FlexiPage"),
    ("permissionsets", r"/permissionsets/([^/]+)\.permissionset-meta\.xml$", "PermissionSet"),
    ("permissionsetgroups", r"/permissionsetgroups/([^/]+)\.permissionsetgroup-meta\.xml$", "PermissionSetGroup"),
    ("profiles", r"/profiles/([^/]+)\.profile-meta\.xml$", "Profile"),
    ("sharingRules", r"/sharingRules/([^/]+)\.sharingRules-meta\.xml$", "SharingRules"),
    ("workflows", r"/workflows/([^/]+)\.workflow-meta\.xml$", "Workflow"),
    ("approvalProcesses", r"/approvalProcesses/([^/]+)\.approvalProcess-meta\.xml$", "ApprovalProcess"),
    ("namedCredentials", r"/namedCredentials/([^/]+)\.namedCredential-meta\.xml$", "NamedCredential"),
    ("externalServiceRegistrations", r"/externalServiceRegistrations/([^/]+)\.externalServiceRegistration-meta\.xml$", "ExternalServiceRegistration"),
    ("customMetadata", r"/customMetadata/([^/]+)\.md-meta\.xml$", "CustomMetadata"),
    ("labels", r"/labels/([^/]+)\.labels-meta\.xml$", "CustomLabels"),
    ("reports", r"/reports/(?:.*/)?([^/]+)\.report-meta\.xml$", "Report"),
    ("dashboards", r"/dashboards/(?:.*/)?([^/]+)\.dashboard-meta\.xml$", "Dashboard"),
    ("duplicateRules", r"/duplicateRules/([^/]+)\.duplicateRule-meta\.xml$", "DuplicateRule"),
    ("matchingRules", r"/matchingRules/([^/]+)\.matchingRule-meta\.xml$", "MatchingRule"),
    ("networks", r"/networks/([^/]+)\.network-meta\.xml$", "Network"),
]
#: Folders that are never read.
SKIPPED = ["node_modules", ".git", ".sfdx", ".sf", "__tests__", "coverage"]


def _files(spark: SparkSession, root: str) -> DataFrame:
    d = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"), F.unix_millis(F.col("_metadata.file_modification_time")).alias("at"))
    for name in SKIPPED:
        d = d.filter(~F.col("path").contains(f"/{name}/"))
    return d


def read_project(spark: SparkSession, root: str, org: str = "org1", namespace: str | None = None) -> DataFrame:
    """Members of the project's package folders (project file's packageDirectories, else force-app).

    Files of one kind are members of their own; the files of a component, and those of an object, are one member
    with its files as JSON (grouped by folder).
    """
    config = spark.read.text(f"{root}/sfdx-project.json", wholetext=True).collect()
    dirs = [p["path"] for p in json.loads(config[0][0]).get("packageDirectories", [])] if config else []
    files = None
    for d in dirs or ["force-app"]:
        part = _files(spark, f"{root}/{d}")
        files = part if files is None else files.unionByName(part)
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for _, pattern, member in FOLDERS:
        hit = F.col("path").rlike(pattern)
        kind, name = F.when(hit, member).otherwise(kind), F.when(hit, F.regexp_extract("path", pattern, 1)).otherwise(name)
    single = files.select(kind.alias("member_type"), name.alias("member_name"), "path", "at", "content").filter("member_type is not null")
    as_json = F.when(F.col("member_type").isin("ApexPage", "ApexComponent"), F.to_json(F.struct(F.col("content").alias("body")))).otherwise(F.col("content"))
    single = single.withColumn("content", as_json)
    lwc = files.withColumn("member_name", F.regexp_extract("path", r"/lwc/([^/]+)/[^/]+$", 1)).filter("member_name <> ''")
    entries = F.map_from_entries(F.collect_list(F.struct(F.regexp_extract("path", r"([^/]+)$", 1), F.col("content"))))
    lwc = lwc.groupBy("member_name").agg(F.to_json(F.struct(F.col("member_name").alias("bundleName"), entries.alias("files"))).alias("content"), F.max("at").alias("at"), F.min("path").alias("path")).withColumn("member_type", F.lit("LightningComponentBundle"))
    objects = files.withColumn("member_name", F.regexp_extract("path", r"/objects/([^/]+)/", 1)).filter("member_name <> ''")
    part = lambda folder: F.map_from_entries(F.collect_list(F.when(F.col("path").contains(f"/{folder}/"), F.struct(F.regexp_extract("path", r"([^/.]+)\.[^/]*$", 1), F.col("content")))))
    objects = objects.groupBy("member_name").agg(
        F.to_json(F.struct(F.col("member_name").alias("apiName"), F.coalesce(F.max(F.when(F.col("path").endswith(".object-meta.xml"), F.col("content"))), F.lit("")).alias("objectXml"), part("fields").alias("fields"), part("recordTypes").alias("recordTypes"), part("validationRules").alias("validationRules"))).alias("content"),
        F.max("at").alias("at"), F.min("path").alias("path"),
    ).withColumn("member_type", F.lit("CustomObject"))
    columns = ["member_type", "member_name", "path", "at", "content"]
    d = single.select(columns).unionByName(lwc.select(columns)).unionByName(objects.select(columns))
    return d.select(F.lit(org).alias("org_id"), F.col("member_type").alias("category"), "member_type", "member_name", F.col("at").alias("last_modified_at"), F.col("path").alias("source_uri"), F.lit(False).alias("obsolete"), F.lit(namespace).cast("string").alias("namespace"), "content")
