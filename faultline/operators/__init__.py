"""Graph, contagion, dependency, multilayer and temporal operators."""
