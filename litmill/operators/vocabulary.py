"""Word lists, labels and patterns of the bundled rules. All are fixed values: results must agree on them."""

# Screening.
BPS_TERMS = ("biopsychosocial", "bio-psycho-social", "bio psycho social")
PEDIATRIC_TERMS = ("child", "children", "adolescent", "adolescents", "pediatric", "paediatric", "youth")
ADULT_TERMS = ("adult", "adults", "older adult", "working-age")
ANIMAL_TERMS = ("rat", "rats", "mouse", "mice", "animal model", "rodent", "canine", "murine")
COMMENTARY_TERMS = ("editorial", "letter", "commentary", "perspective")
CHRONIC_PAIN_TERMS = (
    "chronic pain", "persistent pain", "musculoskeletal", "low back pain", "back pain", "neck pain", "fibromyalgia",
    "osteoarthritis", "temporomandibular", "complex regional pain", "neuropathic pain", "nociplastic pain",
    "pain chronification", "orofacial pain", "headache",
)

# Domains by terms anywhere in the text.
BIO_TERMS = (
    "nociception", "inflammation", "biological", "biomedical", "neuro", "brain", "genetic", "physiological", "mechanism",
    "biomarker", "musculoskeletal", "pharmacological", "central sensitization",
)
PSYCH_TERMS = (
    "psychological", "catastroph", "fear", "avoidance", "depress", "anxiety", "coping", "self-efficacy", "kinesiophobia",
    "acceptance", "illness perception", "resilience", "stress", "cognitive", "emotion",
)
SOCIAL_TERMS = (
    "social", "support", "family", "work", "employment", "socioeconomic", "culture", "stigma", "interpersonal",
    "community", "occupational", "healthcare access",
)

# Concepts, several may hold.
CONCEPTS = {
    "catastrophizing": ("catastroph",),
    "fear-avoidance": ("fear-avoidance", "fear avoidance", "kinesiophobia"),
    "coping": ("coping",),
    "depression": ("depress",),
    "anxiety": ("anxiety",),
    "acceptance": ("acceptance",),
    "illness perception": ("illness perception",),
    "self-efficacy": ("self-efficacy", "self efficacy"),
    "stress": ("stress",),
    "resilience": ("resilience",),
}

# Kinds of pain, the first that holds.
PAIN_CATEGORIES = {
    "chronic secondary musculoskeletal pain": ("musculoskeletal", "low back pain", "neck pain", "osteoarthritis", "spinal", "back pain", "fibromyalgia"),
    "chronic neuropathic pain": ("neuropathic", "neuropathy", "complex regional pain", "crps"),
    "chronic cancer-related pain": ("cancer pain", "oncology"),
    "chronic postsurgical or posttraumatic pain": ("postsurgical", "post-surgical", "postoperative", "post-operative", "posttraumatic", "post-traumatic"),
    "chronic secondary headache or orofacial pain": ("headache", "migraine", "orofacial"),
    "chronic secondary visceral pain": ("pelvic pain", "visceral", "abdominal pain", "endometriosis"),
    "chronic primary pain": ("chronic primary pain",),
}
UNSPECIFIED_PAIN = ("chronic pain", "persistent pain")

# Kinds of review, the first that holds.
REVIEW_TYPES = {
    "network meta-analysis": (r"network\s+meta[- ]analysis", r"bayesian\s+meta[- ]analysis"),
    "meta-analysis": (r"meta[- ]analysis", r"meta[- ]analytic", r"meta\s+synthesis", r"quantitative\s+synthesis"),
    "umbrella review": (r"umbrella\s+review", r"overview\s+of\s+reviews"),
    "scoping or mapping review": (r"scoping\s+review", r"mapping\s+review", r"evidence\s+map"),
    "rapid review": (r"rapid\s+review",),
    "realist review": (r"realist\s+review",),
    "integrative review": (r"integrative\s+review",),
    "systematic review": (r"systematic\s+review",),
    "narrative or expert review": ("review", "clinical update", "state of the art"),
}
COLLAPSED_TYPES = {
    "network meta-analysis": ("network meta",),
    "meta-analysis": ("meta-analysis", "meta analysis"),
    "systematic review": ("systematic",),
    "scoping or mapping": ("scoping", "mapping"),
    "umbrella or overview": ("umbrella", "overview"),
    "rapid review": ("rapid",),
    "realist review": ("realist",),
    "integrative review": ("integrative",),
    "narrative or expert": ("narrative", "expert"),
}

# Objectives and functions, the first that holds.
OBJECTIVES = {
    "conceptual": ("concept", "framework", "model", "theory", "construct"),
    "clinical": ("treatment", "management", "intervention", "rehabilitation"),
    "methodological": ("method", "measurement", "assessment", "tool", "instrument"),
    "epidemiological": ("prevalence", "incidence", "risk factor", "predictor"),
}
FUNCTIONS = {
    "explanatory framework": ("framework", "model", "conceptual model", "theoretical"),
    "intervention rationale": ("approach", "management", "rehabilitation", "treatment"),
    "justification": ("justify", "highlight", "important to consider"),
    "organizing principle": ("organizing", "multidisciplinary", "multifactorial"),
    "conclusion": ("conclude", "implication", "future research"),
}
QUALITY_TERMS = ("risk of bias", "quality assessment", "amstar", "critical appraisal", "quality of evidence")

# Words that say nothing of a domain by themselves, and patterns that do.
LEXICAL_ONLY = r"\bbio[\s-]*psycho[\s-]*social(?:ly)?\b|\bpsycho[\s-]*social(?:ly)?\b"
SUBSTANTIVE = {
    "bio": (
        r"\bbiologic(?:al|ally)?\b", r"\bbiomedical\b", r"\bphysiolog(?:y|ical)\b", r"\bneuro(?:pathic|biology|physiology|imaging)?\b",
        r"\binflamm(?:ation|atory)?\b", r"\bnocicept(?:ive|ion)?\b", r"\bgenetic(?:s)?\b", r"\bpharmacolog(?:y|ical|ic)\b",
        r"\bcentral sensitization\b",
    ),
    "psych": (
        r"\bpsycholog(?:y|ical|ically)\b", r"\bcognit(?:ion|ive)\b", r"\bbehavio(?:u)?ral\b", r"\bdepress(?:ion|ive)?\b",
        r"\banxiet(?:y|ies)\b", r"\bstress(?:or|ors)?\b", r"\bcatastrophi(?:zing|sation)\b", r"\bfear[-\s]?avoidance\b",
        r"\bself[-\s]?efficacy\b", r"\bcoping\b", r"\bmental\b", r"\bemotion(?:al|s)?\b",
    ),
    "social": (
        r"\bsocio(?:economic|cultural)\b", r"\bsocial\s+(?:support|determinants?|context|environment|factors?)\b",
        r"\bfamil(?:y|ies)\b", r"\bcaregiver(?:s)?\b", r"\bpartner(?:s)?\b", r"\bwork(?:place|ing|related)?\b",
        r"\boccupational\b", r"\bemploy(?:ment|ability|ed)?\b", r"\bincome\b", r"\beducation(?:al)?\b", r"\bdeprivation\b",
        r"\binequalit(?:y|ies)\b", r"\bstigma\b", r"\bisolation\b", r"\bcommunity\b", r"\bcultur(?:e|al|ally)\b", r"\bpolicy\b",
        r"\bhealth\s?care access\b", r"\baccess to care\b", r"\blegal\b", r"\bcompensation\b",
    ),
}

# Closed lists of labels.
REVIEW_TYPE_OPTIONS = (
    "systematic review", "meta-analysis", "network meta-analysis", "umbrella review", "scoping or mapping review",
    "rapid review", "realist review", "integrative review", "narrative or expert review", "other evidence synthesis", "unclear",
)
OBJECTIVE_OPTIONS = ("conceptual", "clinical", "methodological", "epidemiological", "mixed", "unclear")
PAIN_OPTIONS = (*PAIN_CATEGORIES, "mixed or unspecified chronic pain", "unclear")
FUNCTION_OPTIONS = (
    "explanatory framework", "intervention rationale", "organizing principle", "justification", "background framing",
    "conclusion", "policy/practice implication", "rhetorical label", "unclear",
)
PROBLEM_OPTIONS = (
    "vague_definition", "tokenistic_bps", "missing_social", "missing_biology", "mechanistic_absence", "construct_overlap",
    "parallel_listing_without_integration", "none",
)
TYPOLOGY_OPTIONS = ("potential integrative signal", "multifactorial signal", "pseudo-bps or partial signal", "rhetorical label signal")
PRIORITY_OPTIONS = ("high", "medium", "low")

# An earlier scheme of coding by keywords.
V1_KEYWORDS = {
    "bio": ("biological", "biomedical", "pathophysiology", "neuro", "nociception", "inflammation", "physiology", "genetic", "biomechanic", "tissue", "central sensitization", "peripheral sensitization"),
    "psych": ("psychological", "fear", "catastroph", "coping", "self-efficacy", "depression", "anxiety", "cognit", "emotion", "acceptance", "kinesiophobia", "stress", "belief", "expectation", "attention", "mindfulness"),
    "social": ("social", "family", "work", "occupational", "interpersonal", "socioeconomic", "culture", "cultural", "social support", "stigma", "healthcare access", "education"),
}
V1_REVIEW_TYPES = {
    "meta-analysis": ("meta-analysis", "meta analysis"),
    "scoping review": ("scoping review",),
    "systematic review": ("systematic review",),
    "narrative review": ("narrative review",),
    "umbrella review": ("umbrella review",),
    "review": ("review",),
}
V1_OBJECTIVES = {
    "conceptual": ("framework", "concept", "operational", "model", "biopsychosocial"),
    "clinical": ("treatment", "management", "intervention", "rehabilitation"),
    "methodological": ("measurement", "psychometric", "assessment", "instrument"),
    "epidemiological": ("prevalence", "incidence", "risk factor", "association"),
}
V1_PAIN = {
    "chronic_secondary_musculoskeletal_pain": ("musculoskeletal", "low back pain", "back pain", "neck pain", "osteoarthritis", "fibromyalgia", "whiplash", "temporomandibular", "rheumatoid", "pelvic girdle"),
    "chronic_neuropathic_pain": ("neuropathic", "complex regional pain", "crps", "radiculopathy"),
    "chronic_cancer_related_pain": ("cancer pain", "oncology pain", "tumor pain"),
    "chronic_secondary_headache_or_orofacial_pain": ("headache", "migraine", "orofacial"),
    "chronic_secondary_visceral_pain": ("visceral", "abdominal pain", "irritable bowel"),
    "chronic_postsurgical_or_posttraumatic_pain": ("postsurgical", "post-surgical", "posttraumatic", "post-traumatic"),
    "chronic_primary_pain": ("chronic primary pain",),
}
V1_FUNCTIONS = {
    "organizing_principle": ("framework", "model", "approach"),
    "conclusion_or_implication": ("important for", "implication", "practice"),
    "justification": ("because", "given the biopsychosocial"),
}
V1_CONCEPTS = {
    "fear-avoidance": r"fear[- ]avoid", "catastrophizing": r"catastroph", "kinesiophobia": r"kinesiophobia", "depression": r"depress",
    "anxiety": r"anxiet", "coping": r"coping", "self-efficacy": r"self[- ]efficacy", "acceptance": r"acceptance",
    "illness perceptions": r"illness perception", "pain beliefs": r"pain belief", "distress": r"distress", "expectations": r"expectation",
    "emotion regulation": r"emotion regulation", "mindfulness": r"mindful", "trauma": r"trauma|ptsd", "sleep": r"sleep",
}
V1_FRAMEWORKS = {
    "fear-avoidance model": r"fear[- ]avoidance", "cognitive behavioral therapy": r"\bcbt\b|cognitive behavioral",
    "acceptance and commitment therapy": r"\bact\b|acceptance and commitment", "illness perception framework": r"illness perception",
    "operant learning": r"operant", "social cognitive theory": r"social cognitive", "self-regulation": r"self-regulation",
}

# The ontology, domains in order with their parts.
ONTOLOGY = {
    "biological": (
        "Central Sensitization and Neuroplasticity",
        "Musculoskeletal and Structural Pathology",
        "Pharmacological and Biomedical Treatment",
        "Sleep Disruption and Circadian Dysregulation",
        "Immune Inflammatory and Neuroinflammatory Processes",
        "Genetic Epigenetic and Biological Vulnerability",
        "Neuroimaging Brain Structure and Function",
        "Nociceptive Transmission and Pain Pathways",
        "Physical Function Mobility and Deconditioning",
        "Metabolic Nutritional and Hormonal Factors",
    ),
    "psychological": (
        "Catastrophizing and Negative Cognitive Appraisal",
        "Fear Avoidance and Pain Related Fear",
        "Depression Emotional Distress and Affect",
        "Anxiety and Psychological Reactivity",
        "Self Efficacy Control Beliefs and Perceived Mastery",
        "Acceptance Psychological Flexibility and Mindfulness",
        "Pain Coping Strategies and Adjustment",
        "Attention Vigilance and Pain Processing",
        "Illness Beliefs Pain Representations and Meaning",
        "Cognitive Behavioral and Psychotherapeutic Approaches",
        "Third Wave Therapies ACT and Contextual Approaches",
        "Resilience Positive Psychology and Post Traumatic Growth",
        "Identity Self Concept and Chronic Pain Biography",
        "Trauma Adverse Childhood and Life Events",
        "Personality Psychological Traits and Individual Differences",
        "Cognitive Function Executive Processes and Brain Health",
        "Motivational Processes Goal Pursuit and Engagement",
        "Healthcare Seeking Treatment Adherence and Engagement",
        "Emotional Regulation and Pain Affect Processing",
        "Mental Health Comorbidity and Psychological Wellbeing",
    ),
    "social": (
        "Social Support Network and Interpersonal Resources",
        "Work Disability Occupational Function and Productivity",
        "Family Caregiver and Household Dynamics",
        "Socioeconomic Status and Health Inequity",
        "Healthcare Access Navigation and System Factors",
        "Cultural Ethnic and Demographic Context",
        "Community Participation and Social Role Functioning",
        "Legal Compensation and Medicolegal Systems",
        "Health Literacy Education and Patient Empowerment",
        "Stigma Social Isolation and Exclusion",
        "Return to Work Vocational Rehabilitation and Employment",
        "Social Determinants of Pain and Environment",
    ),
}
