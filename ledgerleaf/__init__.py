"""DataFrame programs for versioned keys, collections, task graphs and three-way classification trees."""
