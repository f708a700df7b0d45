"""Which services of each vendor are read, as DataFrames that drive the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Services with an offer file.
AWS = (
    "AmazonEC2", "AWSLambda", "AmazonECS", "AmazonEKS", "AmazonLightsail", "CodeBuild", "AWSAppRunner", "ElasticMapReduce",
    "AmazonRDS", "AmazonDynamoDB", "AmazonElastiCache", "AmazonRedshift", "AmazonDocDB", "AmazonNeptune", "AmazonES", "AmazonDAX", "AmazonMemoryDB", "AmazonMCS",
    "AmazonS3", "AmazonEFS", "AmazonFSx", "AmazonECR", "AmazonGlacier", "AmazonS3GlacierDeepArchive",
    "AWSELB", "AmazonVPC", "AmazonRoute53", "AmazonCloudFront", "AmazonApiGateway", "AWSGlobalAccelerator", "AWSDirectConnect", "AWSNetworkFirewall", "AWSDataTransfer", "AWSAppSync",
    "AmazonSNS", "AWSQueueService", "AmazonMQ", "AmazonKinesis", "AmazonKinesisFirehose", "AmazonKinesisAnalytics", "AmazonMSK",
    "AmazonCloudWatch", "AWSConfig", "AWSCloudTrail", "AWSEvents", "AWSSystemsManager", "AWSBackup", "AWSXRay",
    "awskms", "CloudHSM", "awswaf", "AWSCertificateManager", "AmazonCognito", "AWSAmplify",
    "AWSGlue", "AmazonAthena", "AWSSecretsManager", "AWSTransfer", "AmazonStates", "AWSDatabaseMigrationSvc", "AWSDirectoryService", "AmazonGrafana", "AmazonMWAA", "AWSCloudFormation",
)
#: Those that the second partition has, too.
AWS_CN = ("AmazonEC2", "AWSLambda", "AmazonRDS", "AmazonS3", "AmazonDynamoDB", "AmazonElastiCache", "AmazonCloudFront", "AmazonES")
#: Services of the retail price API.
AZURE = (
    "Virtual Machines", "Azure App Service", "Functions", "Azure Kubernetes Service", "Container Instances", "Azure Databricks", "Storage", "Backup", "SQL Database", "SQL Managed Instance",
    "Azure Database for PostgreSQL", "Azure Database for MySQL", "Azure Database for MariaDB", "Azure Cosmos DB", "Azure Synapse Analytics", "Redis Cache",
    "Load Balancer", "VPN Gateway", "Virtual WAN", "Azure DNS", "Azure Firewall", "Application Gateway", "Azure Front Door Service", "Content Delivery Network", "Traffic Manager", "Virtual Network",
    "NAT Gateway", "Azure Bastion", "Azure DDOS Protection", "Network Watcher", "HDInsight", "Azure Data Factory v2", "Azure Cognitive Search", "Cognitive Services", "Power BI Embedded",
    "Azure Monitor", "Log Analytics", "Application Insights", "Automation", "Microsoft Defender for Cloud", "Advanced Threat Protection", "Key Vault", "API Management", "Service Bus", "Event Hubs", "Event Grid",
    "Logic Apps", "SignalR", "Notification Hubs", "Azure Active Directory for External Identities", "Microsoft Entra Domain Services", "Container Registry", "App Configuration", "IoT Hub",
    "ExpressRoute", "Azure NetApp Files", "Stream Analytics", "Azure Analysis Services", "Azure Data Explorer", "Azure Spring Cloud", "Azure Purview", "Azure Grafana Service", "Digital Twins", "Azure Site Recovery",
    "Azure Machine Learning", "Sentinel", "Azure Maps", "Azure Container Apps", "Azure API for FHIR", "Time Series Insights", "Azure Sphere", "Azure Lab Services",
)
#: Services with a known id, and those found by name.
GCP_PINNED = {
    "Compute Engine": "6F81-5844-456A", "Cloud SQL": "9662-B51E-5089", "Cloud Storage": "95FF-2EF5-5EA1", "Cloud Run Functions": "29E7-DA93-CA13", "Cloud Run": "152E-C115-5142",
    "Cloud DNS": "FA26-5236-B8B5", "Networking": "E505-1604-58F8", "Cloud Pub/Sub": "A1E8-BE35-7EBC", "Kubernetes Engine": "CCD8-9BF1-090E",
}
GCP_BY_NAME = ("Cloud Memorystore for Redis", "BigQuery", "Cloud Filestore", "Cloud Bigtable", "Secret Manager", "Cloud Key Management Service (KMS)", "Artifact Registry", "Cloud Logging", "Cloud Spanner", "Cloud Dataflow", "Dataproc")


def aws_tasks(spark: SparkSession, without: tuple[str, ...] = ()) -> DataFrame:
    """service and partition of every offer file."""
    rows = [(s, "aws") for s in AWS] + [(s, "cn") for s in AWS_CN]
    return spark.createDataFrame([r for r in rows if r[0] not in without], "service string, partition string")


def gcp_services(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """name and id: the pinned services, and the wanted ones among ``listed`` (serviceId, displayName)."""
    from pricewright.sources.gcp import merged_services

    pinned = spark.createDataFrame(sorted(GCP_PINNED.items()), "name string, id string")
    return merged_services(pinned, listed, spark.createDataFrame([(n,) for n in GCP_BY_NAME], "name string"))


def outcome(pages: DataFrame) -> DataFrame:
    """Of each service that was read (see the data source ``pages``): the pages that came, and whether it failed."""
    return pages.groupBy("service").agg(F.count("body").alias("pages"), F.max(F.col("error").isNotNull()).alias("failed"))
