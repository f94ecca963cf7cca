"""Vocabularies and policies. Operators take them as arguments; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: word lists that results depend on, each in the order in which it is searched -------------------

NO_SPONSORSHIP = ["no visa sponsorship", "not able to sponsor", "cannot sponsor", "us citizenship required",
                  "must be authorized to work"]

NON_TECH_TITLE = [
    "civil ", "civil engineer", "civil engineering", "structural engineer", "structural eng", "mechanical engineer",
    "mechanical eng", "electrical engineer ", "chemical engineer", "chemical eng", "industrial engineer",
    "biomedical engineer", "petroleum engineer", "environmental engineer", "manufacturing engineer",
    "manufacturing operations", "highway", "roadway", "bridge engineer", "construction", "construction manager",
    "facilities", "facility engineer", "facility manager", "real estate", "property manager", "landscape architect",
    "interior architect", "building architect", "architectural designer", "logistics manager", "supply chain manager",
]

AMBIGUOUS_TITLE = ["architect", "infrastructure"]

TECH_CONTEXT = [
    "software", "cloud", "kubernetes", "k8s", "devops", "platform", "site reliability", "sre", "data", "ml ", "ai ",
    "ai/", "machine learning", "developer", "engineering manager", "security", "network", "systems", "production",
    "backend", "iac", "terraform", "linux", "observability", "sde", "saas",
]

SRE_NICHE = [
    "on-call", "on call rotation", "pager", "incident response", "runbook", "postmortem", "rca", "slo", "sli", "sla",
    "error budget", "reliability engineering", "site reliability", "chaos engineering", "terraform", "pulumi",
    "ansible", "puppet", "chef ", "salt", "infrastructure as code", "iac", "helm chart", "argocd", "flux ",
    "kubernetes operator", "kubernetes platform", "k8s platform", "platform engineering",
    "internal developer platform", "idp", "cluster operations", "cluster management", "multi-cluster",
    "control plane", "prometheus", "grafana", "datadog", "new relic", "splunk", "opentelemetry", "tracing",
    "metrics pipeline", "logging pipeline", "observability", "monitoring", "aws organizations", "aws control tower",
    "landing zone", "vpc peering", "transit gateway", "service mesh", "istio", "linkerd", "ci/cd pipeline",
    "github actions", "jenkins", "spinnaker", "blue/green deploy", "canary deploy", "progressive delivery",
]

CODING_HEAVY = [
    "training pipeline", "model training", "fine-tun", "transformer architecture", "neural network",
    "deep learning research", "ml research", "ai research", "research engineer", "research scientist",
    "computer vision model", "nlp model", "react.js", "vue.js", "angular", "next.js", "ios app", "android app",
    "react native", "swift ", "kotlin ", "frontend framework", "competitive programming", "leetcode",
    "algorithmic problem", "data structures and algorithms", "full-stack developer", "full stack developer",
]

NICHE_TITLE = [
    "site reliability", "sre", "devops", "devsecops", "platform engineer", "platform eng", "infrastructure engineer",
    "cloud engineer", "cloud architect", "production engineer", "systems engineer", "reliability engineer",
    "developer platform", "developer experience", "kubernetes engineer", "k8s engineer",
]

US_PLACES = [
    "united states", "usa", "u.s.a", " us ", "(us)", "(u.s.)", "san francisco", "new york", "nyc", "los angeles",
    "seattle", "boston", "austin", "chicago", "atlanta", "denver", "portland", "miami", "dallas", "houston",
    "san jose", "san diego", "philadelphia", "washington dc", "washington, dc", "raleigh", "durham", "minneapolis",
    "phoenix", "salt lake city", "nashville", "charlotte", "pittsburgh", "detroit", "indianapolis", "columbus",
    "kansas city", "st. louis", "california", "texas", "florida", "new york state", "pennsylvania", "illinois",
    "ohio", "georgia", "north carolina", "michigan", "virginia", "washington", "arizona", "massachusetts",
    "tennessee", "indiana", "missouri", "maryland", "wisconsin", "colorado", "minnesota", "south carolina",
    "alabama", "louisiana", "kentucky", "oregon", "oklahoma", "connecticut", "utah", "iowa", "nevada", "arkansas",
    "mississippi", "kansas", "new mexico", "nebraska", "idaho", "west virginia", "hawaii", "new hampshire", "maine",
    "montana", "rhode island", "delaware", "south dakota", "north dakota", "alaska", "vermont", "wyoming", " est",
    " edt", " pst", " pdt", " cst", " cdt", " mst", " mdt", "eastern time", "pacific time", "central time",
    "mountain time",
]

INDIA_PLACES = ["india", "bangalore", "bengaluru", "hyderabad", "mumbai", "delhi", "new delhi", "pune", "chennai",
                "kolkata", "gurgaon", "gurugram", "noida", "ahmedabad", "jaipur", "kochi", "thiruvananthapuram"]

OTHER_PLACES = [
    "united kingdom", "london, uk", "london, england", "manchester, uk", "germany", "berlin", "munich", "frankfurt",
    "hamburg", "france", "paris,", "netherlands", "amsterdam", "ireland", "dublin", "spain", "madrid", "barcelona",
    "italy", "rome, italy", "milan", "sweden", "stockholm", "switzerland", "zurich, sw", "geneva,", "australia",
    "sydney", "melbourne", "canada", "toronto", "vancouver", "montreal", "brazil", "são paulo", "sao paulo",
    "mexico, mx", "mexico city", "japan", "tokyo,", "singapore", "south korea", "seoul", "hong kong", "philippines",
    "manila", "vietnam", "ho chi minh", "hanoi", "indonesia", "jakarta", "thailand", "bangkok", "uae", "dubai",
    "abu dhabi", "israel", "tel aviv", "south africa", "cape town", "johannesburg", "argentina", "buenos aires",
    "chile", "santiago, cl", "poland", "warsaw", "krakow", "ukraine", "kyiv", "romania", "bucharest", "czech",
    "prague",
]

# of a posting's description; flags it
NO_SPONSORSHIP_FLAGS = ["no visa sponsorship", "not able to sponsor", "cannot sponsor", "sponsorship is not available",
                        "authorization to work in the us", "must be authorized to work", "us citizenship required",
                        "must already be authorized"]

ROLE_CLASS = ["sre", "site reliability", "devops", "platform engineer", "infrastructure", "kubernetes", "k8s",
              "cloud engineer", "devsecops", "reliability engineer", "mlops", "data engineer", "systems engineer",
              "production engineer"]

KNOWN_MODULES = ["amazon", "apple", "google", "meta"]

REMOTE_WORDS = ["remote", "anywhere", "work from home"]

LEGITIMACY_TIERS = {
    "HIGH_CONFIDENCE": ("Posting: HIGH confidence (likely real)", "Legitimacy: HIGH (likely real, active opening)"),
    "PROCEED_WITH_CAUTION": ("Posting: caution (mixed signals)", "Legitimacy: PROCEED WITH CAUTION (mixed signals)"),
    "SUSPICIOUS": ("Posting: SUSPICIOUS (possible ghost job)", "Legitimacy: SUSPICIOUS (multiple ghost-job indicators)"),
}

ATS_KINDS = ["greenhouse", "lever", "ashby", "workday", "smartrecruiters", "icims", "custom"]

# ---- end of fixed values -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """Word lists of the rule engine."""

    no_sponsorship: list[str] = field(default_factory=lambda: NO_SPONSORSHIP)
    non_tech: list[str] = field(default_factory=lambda: NON_TECH_TITLE)
    ambiguous: list[str] = field(default_factory=lambda: AMBIGUOUS_TITLE)
    tech_context: list[str] = field(default_factory=lambda: TECH_CONTEXT)
    niche: list[str] = field(default_factory=lambda: SRE_NICHE)
    coding: list[str] = field(default_factory=lambda: CODING_HEAVY)
    niche_title: list[str] = field(default_factory=lambda: NICHE_TITLE)
    us: list[str] = field(default_factory=lambda: US_PLACES)
    india: list[str] = field(default_factory=lambda: INDIA_PLACES)
    other: list[str] = field(default_factory=lambda: OTHER_PLACES)
    generic_title: str = "software engineer"
