"""Fixed values that results depend on."""

from __future__ import annotations

# Phrases that say nothing about a paper, in the order in which they are tried.
FILLER_PHRASES = [
    "in this paper", "in this work", "in this study", "we propose", "we present", "we introduce", "we develop", "we show",
    "we demonstrate", "we evaluate", "extensive experiments", "experimental results show", "demonstrate that",
    "experiments demonstrate", "outperforms", "outperform", "state-of-the-art", "sota", "baselines", "strong baselines",
    "to this end", "in order to", "towards this goal", "to address this", "to tackle this", "promising results",
    "significant improvement", "novel approach", "novel method", "novel framework", "effective and efficient",
]

# Words that are no keywords.
KEYWORD_STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at",
    "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "out", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "both", "each", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "don", "now", "and", "but",
    "or", "if", "while", "that", "this", "these", "those", "it", "its", "we", "our", "they", "their", "them", "which", "what", "who",
    "whom", "also", "using", "based", "two", "one", "first", "new", "show", "use", "approach", "method", "methods", "results", "paper",
    "work", "model", "models", "data", "problem", "proposed", "existing", "however", "can", "well", "many", "set", "given", "different",
    "respectively", "across", "per", "via",
]

# Terms of method, in the order in which the first four are taken.
METHOD_TERMS = [
    "transformer", "attention", "convolution", "cnn", "rnn", "lstm", "gru", "bert", "gpt", "diffusion", "gan", "vae",
    "reinforcement learning", "contrastive learning", "self-supervised", "semi-supervised", "federated", "graph neural",
    "knowledge graph", "knowledge distillation", "fine-tuning", "pre-training", "zero-shot", "few-shot", "prompt", "retrieval",
    "augmented", "generation", "embedding", "encoder", "decoder", "segmentation", "detection", "classification", "regression",
    "optimization", "gradient", "backpropagation", "normalization", "regularization", "dropout", "pruning", "quantization",
    "distillation", "meta-learning", "multi-task", "transfer learning", "domain adaptation", "adversarial", "robustness",
    "fairness", "interpretability", "explainability", "causal", "bayesian", "variational",
]

# Section type and the headings that mean it; the order is that of partial matches, a later repeat changes the type only.
SECTION_HEADINGS = [
    ("abstract", [
        "abstract",
    ]),
    ("introduction", [
        "introduction",
    ]),
    ("method", [
        "method", "methodology", "approach", "framework", "architecture", "model", "system", "algorithm", "implementation", "training",
        "formulation", "proposed", "design", "pipeline", "procedure", "technique", "strategy", "network", "representation", "feature",
        "features", "learning", "objective", "loss", "inference", "decoding", "encoding", "attention", "mechanism", "module",
        "component", "optimization", "sampling", "generation", "fine-tuning", "pre-training", "pretraining", "prompt", "retrieval",
    ]),
    ("experiment", [
        "experiment", "experiments", "experimental", "evaluation", "results", "analysis", "ablation", "benchmark", "benchmarks", "setup",
        "setting", "settings", "baseline", "baselines", "comparison", "performance", "quantitative", "qualitative", "dataset",
        "datasets", "data", "metric", "metrics", "hyperparameter", "case study", "case studies", "user study", "human evaluation",
    ]),
    ("discussion", [
        "discussion", "limitation", "limitations", "future work", "future direction", "implication", "implications", "challenge",
        "challenges",
    ]),
    ("conclusion", [
        "conclusion", "conclusions", "concluding", "summary", "closing",
    ]),
    ("background", [
        "background", "preliminary", "preliminaries", "problem", "motivation", "overview", "definition", "definitions", "notation",
        "formalism", "task", "setting", "scenario",
    ]),
    ("related_work", [
        "related work", "related works", "prior work", "literature",
    ]),
    ("skip", [
        "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements", "references", "bibliography", "appendix",
        "supplementary", "ethics", "broader impact", "funding", "author contributions", "data availability", "conflict of interest",
    ]),
]
SKIPPED_SECTIONS = ["skip", "related_work"]

# Field by prefix of a category; the texts of chunks know only the first five.
FIELDS = {
    "cs": "Computer Science",
    "math": "Mathematics",
    "stat": "Statistics",
    "physics": "Physics",
    "eess": "Electrical Engineering",
    "q-bio": "Quantitative Biology",
    "q-fin": "Quantitative Finance",
    "econ": "Economics",
}
CHUNK_FIELDS = {k: FIELDS[k] for k in list(FIELDS)[:5]}


def section_keys() -> dict[str, str]:
    """Heading -> type, in the order of partial matches."""
    out: dict[str, str] = {}
    for kind, keys in SECTION_HEADINGS:
        for k in keys:
            out[k] = kind
    return out
