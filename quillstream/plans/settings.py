"""Parameters that queries and their SQL share."""

from quillstream.operators.selection import Rules

# fixed values: terms of the domain and their weights
LEXICON = {
    "retrieval augmented generation": 8,
    "retrieval-augmented generation": 8,
    "corrective rag": 8,
    "self-rag": 8,
    "self rag": 8,
    "agentic retrieval": 7,
    "large language model": 4,
    "language model agent": 5,
    "dense retrieval": 4,
    "sparse retrieval": 4,
    "hybrid retrieval": 4,
    "neural information retrieval": 4,
    "information retrieval": 3,
    "document retrieval": 3,
    "passage retrieval": 3,
    "text retrieval": 4,
    "text ranking": 4,
    "document ranking": 4,
    "passage ranking": 4,
    "listwise reranking": 4,
    "retrieval reranking": 4,
    "re-ranking": 2,
    "reranking": 2,
    "cross encoder": 3,
    "query rewriting": 3,
    "query expansion": 2,
    "question answering": 3,
    "open-domain question answering": 5,
    "open domain question answering": 5,
    "multi-hop question answering": 5,
    "multi hop question answering": 5,
    "semantic search": 3,
    "retrieval grounding": 4,
    "hallucination detection": 3,
    "citation verification": 3,
}
# fixed values: terms of other domains in a title
OFF_TOPIC = [
    "image retrieval", "video retrieval", "visual retrieval", "text-to-visual", "multimodal retrieval", "multi-modal retrieval", "cross-modal retrieval", "instance retrieval", "visual information retrieval",
    "visual analytics", "visual recognition", "vision-language", "computer vision", "multimedia", "person reidentification", "person re-identification", "remote sensing", "satellite", "sentinel", "forest", "grass",
    "crop", "chlorophyll", "vegetation", "x-ray", "medical imaging", "medical image", "liver lesion", "phase retrieval", "orbital imaging", "exoplanet", "protein", "genome", "genomic", "music retrieval", "audio signal",
    "recommender system", "transliteration", "sentence simplification", "bilingual lexicon", "bridge maintenance", "time series", "subspace clustering", "long-read assembly", "action recognition", "currency strategies",
    "tag-cloud",
]
# fixed values: terms in a title that outweigh those of other domains
SAVING = [
    "retrieval augmented generation", "retrieval-augmented generation", "large language model", "language model agent", "corrective rag", "self-rag", "self rag", "agentic retrieval",
]
# fixed values: terms one of which the title of a retained work has
ON_TOPIC = [
    "retrieval augmented", "retrieval-augmented", "rag-augmented", "rag system", "retrieval augmented language model", "retrieval augmented text generation", "retrieval-augmented text generation", "neural ranking",
    "cross-lingual retrieval", "zero-shot retrieval", "retrieval augmented generation", "retrieval-augmented generation", "corrective rag", "self-rag", "self rag", "agentic retrieval", "large language model",
    "language model agent", "dense retrieval", "sparse retrieval", "hybrid retrieval", "neural information retrieval", "information retrieval", "document retrieval", "passage retrieval", "text retrieval", "text ranking",
    "document ranking", "passage ranking", "listwise reranking", "retrieval reranking", "re-ranking", "reranking", "cross encoder", "query rewriting", "query expansion", "question answering", "semantic search",
]
RULES = Rules(LEXICON, OFF_TOPIC, SAVING, ON_TOPIC)
WINDOW = ("2023-01-01", "2024-06-30", 540)
CUTOFF = "2026-07-01 00:00:00"
FAILS = ("retracted", "missing_title", "missing_abstract", "missing_downloadable_content")
RUNS = ("dense", "sparse", "dense+sparse")
JOURNALS = {"annals of vovo-ir studies": "vovo", "annals of hedulrank studies": "hedul"}  # short names that do not follow from the names
