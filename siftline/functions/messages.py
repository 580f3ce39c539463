"""Texts that appear in decision rows.

Reports group by them, so they are part of the result.
"""

# ---------------------------------------------------------------------------
# Category -> (confidence, reasoning, recommended action).
# ---------------------------------------------------------------------------
INTENT = {
    "ml_research_paper": (
        0.95,
        "This appears to be an ML research paper or technique discussion. It describes ML concepts, methodologies, or theoretical work, not a predictive task requiring model training.",
        "Provide conceptual explanation, key ideas, practical implications, and limitations. No dataset, model training, or metrics apply.",
    ),
    "system_design": (
        0.9,
        "This appears to be a system design or architecture explanation. It describes how systems work, not a predictive ML task.",
        "Provide system explanation and design insights. No model training needed.",
    ),
    "research_discussion": (
        0.9,
        "This input describes an ML concept or research work, not a predictive task. No dataset, model training, or metrics apply.",
        "Provide conceptual explanation, key ideas, practical implications, and limitations. No model training needed.",
    ),
    "news_announcement": (
        0.85,
        "This appears to be a news item or announcement, not an ML problem requiring model training.",
        "Tag as news/announcement. Extract key information if relevant.",
    ),
    "personal_experience": (
        0.8,
        "This appears to be a personal experience or opinion post, not a defined ML problem.",
        "Tag as personal experience. Extract insights if valuable.",
    ),
    "product_discussion": (
        0.8,
        "This appears to be a product, startup, or career discussion, not an ML problem.",
        "Tag appropriately. No ML training needed.",
    ),
    "exploratory_analysis": (
        0.7,
        "This appears to be an exploratory data analysis request, not a predictive ML task.",
        "Use data exploration tools. No predictive model needed.",
    ),
    "predictive_ml_task": (
        0.8,
        "Contains ML action verbs and keywords indicating a predictive ML task.",
        "No action needed",
    ),
    "unknown": (
        0.5,
        "Cannot clearly classify content type. Insufficient information to determine if this is a predictive ML task.",
        "Request clarification on content type and requirements.",
    ),
}
INTENT_ESCAPED = (0.6, "Contains discussion markers but also has ML action intent")
INTENT_SKIPPED = (
    1.0,
    "Direct problem mode: User explicitly provided ML problem. Intent classification skipped.",
)
FEASIBLE_CANONICAL = "Problem is well-posed using canonicalized information. Target variable, features, and task type identified."
FEASIBLE_TEXT = "Target variable, features, data source, and intended use identified or inferable. Problem is well-posed for ML training."
MISSING_PREFIX = "Problem is not well-posed for ML training. Missing: "
MISSING_SUFFIX = ". Cannot proceed without explicit target variable, input features, data source, and intended use."
AMBIGUOUS_PREFIX = "Problem definition is ambiguous: "
AMBIGUOUS_SUFFIX = ". In strict mode, ambiguous problems are rejected."
MISSING_TARGET = "target variable"
MISSING_FEATURES = "input features or data source"
MISSING_USE = "intended use of predictions"
AMBIGUOUS_TARGET = "target variable (multiple candidates)"
AMBIGUOUS_FEATURES = "input features (too many candidates, may be ambiguous)"
DEFAULT_TARGET = "inferred from context"
DEFAULT_FEATURES = "to be extracted from dataset"
DEFAULT_SOURCE = "to be discovered"
DEFAULT_USE = "not explicitly stated"
DEFAULT_CANONICAL_USE = "business decision support"
INSUFFICIENT_ACTION = "Clarify target variable, input features, data source, and intended use of predictions"
INSUFFICIENT_JUSTIFICATION = "Problem is not well-posed for ML training. Missing required information."
CONCEPTS = ("training paradigm", "model internals/learning theory", "architectural mechanism")
RESEARCH_PREFIX = "This input discusses "
RESEARCH_SUFFIX = ". These are research concepts, not a predictive task. Do NOT select datasets, choose regression/classification, or output metrics."
RESEARCH_ACTION = "Provide conceptual explanation, key ideas, practical implications, and limitations instead of training a model."
RESEARCH_JUSTIFICATION = "This input describes research concepts, not a predictive task. No dataset, model training, or metrics apply."
NOT_RESEARCH = "This appears to be an application task, not a research concept discussion."
CAUSAL = {
    "high_stakes": (
        "This is a decision-making problem in a high-stakes domain. Correlation-based ML models could cause harm. Causal modeling or experimentation is required, but not mentioned.",
        "Use causal inference methods (SCMs, do-calculus) or randomized experiments. Do not use observational correlation-based models.",
    ),
    "warned": (
        "The problem explicitly mentions correlation concerns. Correlation-based ML models are not appropriate here.",
        "Address causal structure before modeling. Consider causal inference methods.",
    ),
    "low": (
        "This appears to be a pure prediction task without direct decision-making. Correlation-based models may be acceptable.",
        None,
    ),
    "medium": (
        "This involves decision-making. Consider causal validity, but correlation-based models may be acceptable with proper validation.",
        None,
    ),
}
CAUSAL_JUSTIFICATION = "Causal validity concerns prevent correlation-based model training."
JUSTIFY = {
    "implicit_regression": (
        'Regression was inferred but not explicitly mentioned. In strict mode, we never assign "regression" by default without explicit indication.',
        "Clarify task type. Do not default to regression.",
    ),
    "simple_rule": (
        "This problem may be solvable with simple rules or heuristics. ML may be overkill.",
        "Consider rule-based solution first. Only use ML if rules are insufficient.",
    ),
    "direct": (
        "Direct problem mode: User explicitly provided ML problem. Dataset discovery will attempt to find appropriate data.",
        None,
    ),
    "no_dataset": (
        "Dataset not explicitly mentioned. In strict mode, we never hallucinate datasets. Dataset must be explicitly provided or mentioned.",
        "Require explicit dataset mention or provision. Do not invent or assume datasets.",
    ),
    "dataset_later": (
        "Dataset not explicitly mentioned, but dataset discovery module will attempt to find appropriate data.",
        None,
    ),
    "unclear_task": (
        'Task type "%s" is not explicitly clear. Task type must be explicitly stated or clearly inferable from context.',
        "Clarify task type explicitly. Do not infer without strong evidence.",
    ),
    "ok": (
        "ML is justified. Problem complexity and requirements suggest ML is appropriate. Task type is explicit, dataset is mentioned or discoverable.",
        None,
    ),
}
CAUSAL_WARNING = {"medium": "Monitor for distribution shift and validate causal assumptions if deployed."}
JUSTIFY_NOTE = {
    "direct": "CRITICAL: Ensure dataset discovery finds REAL, appropriate datasets. NO hallucination allowed. If no suitable dataset found, reject training.",
    "dataset_later": "CRITICAL: Ensure dataset discovery finds REAL, appropriate datasets. NO hallucination allowed. If no suitable dataset found, reject training.",
    "ok": "Proceed with %s model family. Ensure dataset is real and appropriate before training.",
}
JUSTIFY_WARNING = {
    "direct": "Dataset discovery must validate dataset exists and is appropriate before proceeding.",
    "dataset_later": "Dataset discovery must validate dataset exists and is appropriate before proceeding.",
}
CONCEPT_TYPE = "research_concept"
UNJUSTIFIED_JUSTIFICATION = "ML is not justified for this problem. Simpler alternatives may be more appropriate."
TRAIN_REASONING = "All validation gates passed. ML model training is appropriate."
TRAIN_ACTION = "Proceed with model training"
DIRECT_REASONING = "Problem enhanced and validated. Proceeding with ML training."
DIRECT_JUSTIFICATION = "Problem statement has been enhanced to be a well-formed ML problem."
DISCUSSION = "This appears to be a theoretical discussion or research post, not an actual ML problem requiring model training. Discussion posts about ML concepts, failures, or frameworks should not be treated as supervised learning tasks."
NO_ML = "No ML-related keywords found"
RULE_PREFIX = "Rule-based classification: "
RULE_SUFFIX = " task detected"
EMPTY_TEXT = "Empty problem text"
DEFAULT_KEY_FEATURES = ("features", "data")
DEFAULT_INPUT_FEATURES = ("feature1", "feature2", "feature3")
# --- end of fixed values ---------------------------------------------------
