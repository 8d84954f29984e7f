"""Named analyses of published work: which table is built and which tool reads it."""

from __future__ import annotations

# Builder and tool settings of the published analyses.
PRESETS: dict[str, dict] = {
    "watanabe2021": {"builder": "weight_graph", "builder_options": {"edge_weight": "relevance", "scope": "full"}, "tool": "ph", "tool_options": {"max_dim": 1, "complex": "directed_clique"}},
    "rieck2019": {"builder": "weight_graph", "builder_options": {"edge_weight": "normalized", "scope": "bipartite"}, "tool": "ph", "tool_options": {"max_dim": 0}},
    "gebhart2019": {"builder": "weight_graph", "builder_options": {"edge_weight": "weighted_activation", "scope": "multipartite"}, "tool": "ph", "tool_options": {"max_dim": 0}},
    "lacombe2021": {"builder": "weight_graph", "builder_options": {"edge_weight": "weighted_activation", "scope": "bipartite"}, "tool": "ph", "tool_options": {"max_dim": 0}},
    "naitzat2020": {"builder": "activation_graph", "builder_options": {"distance": "geodesic", "k": None}, "tool": "ph", "tool_options": {"max_dim": 1}},
    "karuppiah2025": {"builder": "activation_graph", "builder_options": {"distance": "euclidean"}, "tool": "ph", "tool_options": {"max_dim": 1}},
    "ballester2024": {"builder": "activation_graph", "builder_options": {"distance": "correlation", "drop_constant": True, "max_neurons": 300}, "tool": "ph", "tool_options": {"max_dim": 1, "statistics": "moments"}},
    "ramamurthy2019": {"builder": "labelled_complex_graph", "builder_options": {"distance": "euclidean"}, "tool": "ph", "tool_options": {"max_dim": 1}},
    "liu2023": {"builder": "polyhedral_graph", "builder_options": {}, "tool": "ph", "tool_options": {"max_dim": 1}},
    "rathore2021": {"builder": "activation_graph", "builder_options": {"distance": "euclidean"}, "tool": "mapper", "tool_options": {"lens": "l2_norm", "n_intervals": 70, "overlap": 0.3}},
    "zhou2023": {"builder": "activation_graph", "builder_options": {"distance": "euclidean"}, "tool": "mapper", "tool_options": {"lens": "l2_norm", "n_intervals": 40, "overlap": 0.2}},
    "gabrielsson2019": {"builder": "activation_graph", "builder_options": {"distance": "vne"}, "tool": "mapper", "tool_options": {"lens": "pca2", "n_intervals": 30, "overlap": 0.667}},
    "gabella2021": {"builder": "activation_graph", "builder_options": {"distance": "euclidean"}, "tool": "mapper", "tool_options": {"lens": "l2_norm", "n_intervals": 10, "overlap": 0.3}},
    "ruppik2025": {"builder": None, "builder_options": {}, "tool": "dimension", "tool_options": {"method": "local"}},
    "ong2026": {"builder": None, "builder_options": {}, "tool": "dimension", "tool_options": {"method": "calibrated", "k": 2, "j": 1}},
    "birdal2021": {"builder": None, "builder_options": {}, "tool": "dimension", "tool_options": {"method": "ph_euclidean", "alpha": 1.0}},
    "dupuis2023": {"builder": None, "builder_options": {}, "tool": "dimension", "tool_options": {"method": "ph_loss", "alpha": 1.0}},
    "andreeva2024": {"builder": None, "builder_options": {}, "tool": "dimension", "tool_options": {"method": "magnitude"}},
}


def describe(name: str) -> str:
    p = PRESETS[name]
    return f"{name}: {p['builder'] or 'the cloud itself'} {p['builder_options']} -> {p['tool']} {p['tool_options']}"
