"""Small relations that the web client holds as literals, and the schemas of the board's entities."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The rows that the client shows.
BROWSE = (
    ("1", "Senior Software Engineer", "TechCorp Inc.", "Job Offer", "Remote", "$120k - $160k", "2 days ago", "Mar 15, 2026", "We're looking for an experienced software engineer to join our platform team...", ["React", "Node.js", "TypeScript"], False),
    ("2", "AI Research Grant", "National Science Foundation", "Funding", "Nationwide", "$500k - $2M", "1 week ago", "Apr 30, 2026", "Grant funding for innovative AI research projects in healthcare and education...", ["AI/ML", "Research", "Healthcare"], True),
    ("3", "Mobile App Development Project", "HealthTech Solutions", "Project", "Hybrid - Boston, MA", "$80k - $100k", "3 days ago", "Mar 25, 2026", "3-month contract to build a patient management mobile application...", ["React Native", "Mobile", "Healthcare"], False),
    ("4", "Climate Change Research Position", "University of California", "Research", "Berkeley, CA", "$65k - $75k", "5 days ago", "Apr 10, 2026", "Postdoctoral position studying climate impact on coastal ecosystems...", ["Climate", "Research", "PhD Required"], False),
    ("5", "UX Designer", "DesignHub", "Job Offer", "New York, NY", "$90k - $120k", "1 day ago", "Mar 20, 2026", "Join our design team to create beautiful, user-centered experiences...", ["UI/UX", "Figma", "Design Systems"], True),
    ("6", "Blockchain Development Grant", "Ethereum Foundation", "Funding", "Remote", "$100k - $250k", "4 days ago", "May 1, 2026", "Funding for open-source blockchain infrastructure projects...", ["Blockchain", "Web3", "Open Source"], False),
)
SAVED = (
    ("2", "AI Research Grant", "National Science Foundation", "Funding", "Nationwide", "$500k - $2M", "Apr 30, 2026", "Active", ["AI/ML", "Research", "Healthcare"]),
    ("5", "UX Designer", "DesignHub", "Job Offer", "New York, NY", "$90k - $120k", "Mar 20, 2026", "Active", ["UI/UX", "Figma", "Design Systems"]),
    ("8", "Open Source Development", "Mozilla Foundation", "Project", "Remote", "$60k - $80k", "Mar 28, 2026", "Active", ["JavaScript", "Open Source"]),
)
APPLIED = (
    ("1", "Senior Software Engineer", "TechCorp Inc.", "Job Offer", "Feb 5, 2026", "Under Review", "2 days ago"),
    ("7", "Data Science Research", "Stanford University", "Research", "Jan 28, 2026", "Interview Scheduled", "5 days ago"),
)
POSTED = (
    ("1", "Senior Software Engineer", "Job Offer", "Active", "Feb 8, 2026", "Mar 15, 2026", 42, 328),
    ("3", "Mobile App Development Project", "Project", "Active", "Feb 7, 2026", "Mar 25, 2026", 18, 156),
    ("9", "Junior Developer", "Job Offer", "Closed", "Jan 15, 2026", "Feb 15, 2026", 87, 542),
)
#: The detail page's only row, but for its id, which comes from the address.
DETAIL = {
    "title": "Senior Software Engineer",
    "organization": "TechCorp Inc.",
    "organizationLogo": "https://via.placeholder.com/80",
    "type": "Job Offer",
    "location": "Remote",
    "locationType": "Fully Remote",
    "salary": "$120,000 - $160,000",
    "postedDate": "February 8, 2026",
    "deadline": "March 15, 2026",
    "employmentType": "Full-time",
    "experience": "5+ years",
    "tags": ["React", "Node.js", "TypeScript", "PostgreSQL", "AWS"],
    "description": "We're looking for an experienced Senior Software Engineer to join our platform team. You'll be working on building and scaling our core product used by thousands of companies worldwide.",
    "responsibilities": [
        "Design and implement new features for our platform",
        "Lead technical discussions and architectural decisions",
        "Mentor junior engineers and conduct code reviews",
        "Collaborate with product and design teams",
        "Optimize application performance and scalability",
    ],
    "requirements": [
        "5+ years of professional software development experience",
        "Strong expertise in React, Node.js, and TypeScript",
        "Experience with PostgreSQL and database design",
        "Familiarity with AWS services and cloud architecture",
        "Excellent problem-solving and communication skills",
    ],
    "benefits": [
        "Competitive salary and equity package",
        "Health, dental, and vision insurance",
        "401(k) matching",
        "Unlimited PTO",
        "Remote work flexibility",
        "Professional development budget",
    ],
    "about": "TechCorp Inc. is a leading software company building tools that empower teams to work more efficiently. Founded in 2015, we've grown to serve over 10,000 customers across 50 countries.",
    "applicationUrl": "https://example.com/apply",
}
TYPE_COUNTS = (("Job Offers", "1,234"), ("Projects", "567"), ("Funding", "189"), ("Research", "342"))
EXPERIENCE = {"DEBUTANT": "Débutant (0–1 an)", "JUNIOR": "Junior (1–3 ans)", "CONFIRME": "Confirmé (3–5 ans)", "SENIOR": "Senior (5+ ans)"}

#: The codes of the enumerations.
ENUMS = {
    "type_opportunite": ("EMPLOI", "STAGE", "PROJET", "FINANCEMENT", "RECHERCHE"),
    "statut_opportunite": ("ACTIVE", "EXPIREE", "ARCHIVEE"),
    "type_source": ("SITE_EMPLOI", "PORTAIL_PROJET", "AUTRE"),
    "statut_candidature": ("VUE", "INTERESSEE", "POSTULEE_EXTERNEMENT", "ABANDONNEE"),
    "type_document": ("CV", "LETTRE", "DOSSIER", "AUTRE"),
    "niveau_experience": ("DEBUTANT", "JUNIOR", "CONFIRME", "SENIOR"),
    "type_notification": ("RECOMMANDATION", "RAPPEL_ECHEANCE", "INFO_SYSTEME", "ERREUR_SOURCE"),
    "account_type": ("CANDIDAT", "ORGANISATION"),
}

SCHEMAS = {
    "utilisateur": "id long not null, username string not null, email string not null, first_name string not null, last_name string not null, is_staff boolean not null, is_active boolean not null, is_superuser boolean not null, date_joined timestamp not null, last_login timestamp",
    "groupe": "id long not null, name string not null",
    "utilisateur_groupe": "utilisateur_id long not null, groupe_id long not null",
    "profil": "id long not null, utilisateur_id long not null, nom string not null, prenom string not null, competences string not null, domaines_interet string not null, niveau_experience string not null, annees_experience int",
    "source": "id long not null, nom string not null, url string not null, type_source string not null",
    "opportunite": "id long not null, titre string not null, description string not null, type_opportunite string not null, statut string not null, date_publication date not null, date_limite date, organisation_id long, source_id long not null, date_creation timestamp not null, date_modification timestamp not null",
    "candidature": "id long not null, candidat_id long not null, opportunite_id long not null, statut string not null, url_source string, date_creation timestamp not null, derniere_mise_a_jour timestamp not null",
    "document": "id long not null, candidature_id long not null, type_document string not null, fichier string not null, date_upload timestamp not null",
    "notification": "id long not null, utilisateur_id long not null, type_notification string not null, message string not null, lu boolean not null, date_creation timestamp not null",
}


def browse(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BROWSE, "id string, title string, organization string, type string, location string, salary string, postedDate string, deadline string, description string, tags array<string>, saved boolean")


def saved(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAVED, "id string, title string, organization string, type string, location string, salary string, deadline string, status string, tags array<string>")


def applied(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(APPLIED, "id string, title string, organization string, type string, appliedDate string, status string, lastUpdate string")


def posted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POSTED, "id string, title string, type string, status string, posted string, deadline string, applicants int, views int")


def detail(spark: SparkSession, id: str | None) -> DataFrame:
    """One wide row with nested lists; only its id varies, "1" where there is none."""
    fields = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in DETAIL.items())
    return spark.createDataFrame([(id or "1", *DETAIL.values())], f"id string, {fields}")


def type_counts(spark: SparkSession) -> DataFrame:
    """What the home page shows as constants; plans.queries counts real rows as active_by_type."""
    return spark.createDataFrame(TYPE_COUNTS, "title string, count string")
